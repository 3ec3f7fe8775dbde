"""Spark jobs over site, interval, genotype, genealogy and gene-set tables."""
