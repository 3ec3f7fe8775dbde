"""Genealogies as three tables (nodes, edges, mutations) keyed by run, region and sample index; one local tree a site."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandloom.operators.carry import work_parts

KEY = ("run", "region", "sample_idx")


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges without a parent (negative number) drop out."""
    return edges.where("parent >= 0")


def strict_times(times: np.ndarray, least: float = 1e-4) -> np.ndarray:
    """Node times in order of node number, made to rise by at least ``least`` above the leaves' zeros."""
    out = times.astype(float).copy()
    last = 0.0
    for i in np.flatnonzero(out > 0):
        last = out[i] = max(out[i], last + least)
    return out


def clean_genealogy(nodes: DataFrame, edges: DataFrame, least: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(nodes with strictly rising times, edges with a parent).

    Genealogies are dealt by key and sorted; a task reads its rows in that order and carries the last time over its batches, so
    that neither many small genealogies cost a call each nor a large one is held whole."""

    def fix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, last = None, 0.0
        for pdf in frames:
            rows = []
            for run, region, sample, time in zip(*(pdf[c].tolist() for c in KEY), pdf["time"].astype(float).tolist(), strict=True):
                key = tuple(None if k != k else k for k in (run, region, sample))
                if key != before:
                    before, last = key, 0.0
                if time > 0:
                    time = last = max(time, last + least)
                rows.append(time)
            yield pdf.assign(time=rows)

    dealt = nodes.repartition(work_parts(nodes.sparkSession, nodes.count()), *KEY).sortWithinPartitions(*KEY, F.col("node_id").asc_nulls_last())
    return dealt.mapInPandas(fix, nodes.schema), clean_edges(edges)


class Tree:
    """One local tree, changed edge by edge. For every node: parent, children, how many leaves of each species hang below; and the
    nodes of the tree, and its inner ones, by age. Inserting or removing an edge walks up from it once."""

    def __init__(self, time: dict[int, float], pairs: Iterable[tuple[int, int]], species: dict[int, int]):
        """``species``: of a leaf, as a bit (1, 2, 4, ...). A node of ``species`` counts as a leaf while it has no children."""
        self.time, self.species = time, species
        self.parent: dict[int, int] = {}
        self.children: dict[int, list[int]] = {}
        self.below: dict[int, dict[int, int]] = {}
        self.degree: dict[int, int] = {}
        self.ages: list[float] = []
        self.inner: list[tuple[float, int]] = []
        for p, c in pairs:
            self.insert(p, c)

    def _climb(self, n: int, counts: Iterable[tuple[int, int]], sign: int) -> None:
        counts = list(counts)
        while counts:
            own = self.below.setdefault(n, {})
            for bit, many in counts:
                left = own.get(bit, 0) + sign * many
                if left:
                    own[bit] = left
                else:
                    own.pop(bit, None)
            if n not in self.parent:
                return
            n = self.parent[n]

    def _count(self, n: int, change: int) -> None:
        was = self.degree.get(n, 0)
        self.degree[n] = was + change
        if not was:
            insort(self.ages, self.time[n])
            if n in self.species and n not in self.children:
                self.below[n] = {self.species[n]: 1}
        elif not was + change:
            self.ages.pop(bisect_left(self.ages, self.time[n]))

    def insert(self, p: int, c: int) -> None:
        for n in (p, c):
            self._count(n, 1)
        if p not in self.children:
            self.children[p] = []
            insort(self.inner, (self.time[p], p))
            if p in self.species:
                self._climb(p, [(self.species[p], 1)], -1)
        self.children[p].append(c)
        self.parent[c] = p
        self._climb(p, self.below.get(c, {}).items(), 1)

    def remove(self, p: int, c: int) -> None:
        self._climb(p, self.below.get(c, {}).items(), -1)
        del self.parent[c]
        self.children[p].remove(c)
        if not self.children[p]:
            del self.children[p]
            self.inner.pop(bisect_left(self.inner, (self.time[p], p)))
            if p in self.species:
                self._climb(p, [(self.species[p], 1)], 1)
        for n in (p, c):
            self._count(n, -1)

    def nonroot(self, n: int) -> bool:
        return n in self.parent

    def few_lineages(self, n: int, most: int = 2) -> bool:
        """At most ``most`` nodes are older than the middle of the branch above ``n``."""
        if n not in self.parent:
            return False
        return len(self.ages) - bisect_right(self.ages, (self.time[n] + self.time[self.parent[n]]) / 2) <= most

    def splits_species(self, n: int) -> bool:
        """The first split at or below ``n`` parts it into two clades of one species each, and not the same one."""
        while len(self.children.get(n, ())) == 1:
            n = self.children[n][0]
        pair = self.children.get(n, ())
        if len(pair) != 2:
            return False
        a, b = (list(self.below.get(c, ())) for c in pair)
        return len(a) == len(b) == 1 and a != b

    def passes(self, n: int) -> bool:
        return self.nonroot(n) and self.few_lineages(n) and self.splits_species(n)


class Sweep:
    """The local trees of one genealogy at rising positions: edges enter at their left end and leave at their right one."""

    def __init__(self, time: dict[int, float], left: np.ndarray, right: np.ndarray, parent: np.ndarray, child: np.ndarray, species: dict[int, int]):
        self.pairs = list(zip(parent.tolist(), child.tolist(), strict=True))
        self.enter, self.leave = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        self.left, self.right = left[self.enter].tolist(), right[self.leave].tolist()
        self.enter, self.leave = self.enter.tolist(), self.leave.tolist()
        self.tree, self.entered, self.left_behind = Tree(time, (), species), 0, 0
        self.spans = list(zip(left.tolist(), right.tolist(), strict=True))
        self.inside: set[int] = set()

    def at(self, pos: float) -> Tree:
        """The tree at ``pos``, not below the position before. All edges that have ended go before any comes in."""
        here = []
        while self.entered < len(self.left) and self.left[self.entered] <= pos:
            edge = self.enter[self.entered]
            if self.spans[edge][1] > pos:  # what ends before the next site never comes in
                here.append(edge)
            self.entered += 1
        while self.left_behind < len(self.right) and self.right[self.left_behind] <= pos:
            edge = self.leave[self.left_behind]
            if edge in self.inside:
                self.inside.discard(edge)
                self.tree.remove(*self.pairs[edge])
            self.left_behind += 1
        for edge in here:
            self.inside.add(edge)
            self.tree.insert(*self.pairs[edge])
        return self.tree


def topology_metrics(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, sites: DataFrame, leaves: DataFrame) -> DataFrame:
    """For each (run, region, sample_idx) and site (region, chrom, pos): the local tree's verdicts.

    ``mutations``: position, node, derived_state; ``leaves``: node_id, species (0, 1, ...). The oldest mutation is the one whose
    node is oldest, of equals that of the lower node, then of the lesser state (null last); n_fwd counts mutations of its state
    (none if that is null), n_rev the others. ``first``: it is off the root, few lineages are older,
    and it splits the species; if it is on the root the second oldest is tested (``second``; false where there is none).
    ``yellow``: the second-oldest inner node parts two clades of one species each. ``node_age`` and ``branch_midpoint`` of the
    tested mutation are both given. Each sample is scored on its own. The three tables meet in one group a sample, where the tree
    is swept along the sites: the work is that of the edges times the tree's depth, and of the sites.

    Edges and mutations on a node that ``nodes`` lacks have no age and are left out; a site without a mutation left has no row."""
    species = {r["node_id"]: 1 << r["species"] for r in leaves.select("node_id", "species").collect()}  # one row a haplotype
    tagged = (
        nodes.select(*KEY, F.lit(0).alias("t"), F.col("node_id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("time").cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("string").alias("s"))
        .unionByName(clean_edges(edges).select(*KEY, F.lit(1).alias("t"), F.col("parent").cast("long").alias("a"), F.col("child").cast("long").alias("b"), F.col("left").cast("double").alias("x"), F.col("right").cast("double").alias("y"), F.lit(None).cast("string").alias("s")))
        .unionByName(mutations.select(*KEY, F.lit(2).alias("t"), F.col("node").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("position").cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.col("derived_state").cast("string").alias("s")))
    )
    keys = nodes.select(*KEY).distinct()
    asked = sites.select("region", "chrom", "pos").join(keys, "region").select(*KEY, F.lit(3).alias("t"), F.col("pos").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.col("chrom").cast("string").alias("s"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf[pdf["t"] == 0]
        n = n.sort_values("a")
        time = dict(zip(n["a"].astype(int).tolist(), strict_times(n["x"].to_numpy()).tolist(), strict=True))
        e, m, want = (pdf[pdf["t"] == i] for i in (1, 2, 3))
        e, m = e[e["a"].isin(time.keys()) & e["b"].isin(time.keys())], m[m["a"].isin(time.keys())].sort_values("x", kind="stable")
        sweep = Sweep(time, *(e[c].to_numpy() for c in ("x", "y")), *(e[c].to_numpy(np.int64) for c in ("a", "b")), species)
        want = want.sort_values("a", kind="stable")
        sites, places, on, states = want["a"].to_numpy(np.int64), m["x"].to_numpy(float), m["a"].to_numpy(np.int64).tolist(), m["s"].tolist()
        low, high = (np.searchsorted(places, sites, side).tolist() for side in ("left", "right"))
        run, region, sample = pdf["run"].iloc[0], pdf["region"].iloc[0], pdf["sample_idx"].iloc[0]
        out = []
        for pos, chrom, begin, end in zip(sites.tolist(), want["s"], low, high, strict=True):
            if begin == end:
                continue
            tree = sweep.at(pos)
            rows = sorted(((time[on[i]], on[i], states[i]) for i in range(begin, end)), key=lambda r: (-r[0], r[1], r[2] is None, r[2] or ""))
            age, node, state = rows[0]
            fwd = sum(r[2] == state for r in rows if state is not None)
            nonroot = tree.nonroot(node)
            first = tree.passes(node)
            second, tested = False, node
            if not nonroot and len(rows) > 1:
                tested = rows[1][1]
                second = tree.passes(tested)
            yellow = len(tree.inner) > 1 and tree.splits_species(tree.inner[-2][1])
            mid = (time[tested] + time[tree.parent[tested]]) / 2 if tested in tree.parent else None
            out.append((run, region, sample, chrom, pos, len(rows), fwd, len(rows) - fwd, age, tree.splits_species(tested), tree.few_lineages(tested), nonroot, first, second, yellow, time[tested], mid))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _METRICS.split(", ")])

    return tagged.unionByName(asked).repartition(work_parts(nodes.sparkSession, nodes.count()), *KEY).groupBy(*KEY).applyInPandas(score, _METRICS)


_METRICS = "run long, region string, sample_idx long, chrom string, pos long, n_mut long, n_fwd long, n_rev long, oldest_age double, coalesce_ok boolean, nodes_ok boolean, nonroot boolean, first boolean, second boolean, yellow boolean, node_age double, branch_midpoint double"


def branch_ages(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, min_freq: float = 0.0) -> DataFrame:
    """Midpoint of the branch under each mutation of at least ``min_freq`` (column ``freq``): (child time + parent time) / 2."""
    time = nodes.select(*KEY, "node_id", "time")
    m = mutations.where(F.col("freq") >= min_freq).join(clean_edges(edges), list(KEY)).where("child = node and left <= position and position < right")
    m = m.join(time.select(*KEY, F.col("node_id").alias("child"), F.col("time").alias("lower")), [*KEY, "child"]).join(time.select(*KEY, F.col("node_id").alias("parent"), F.col("time").alias("upper")), [*KEY, "parent"])
    return m.select(*KEY, "position", "node", "lower", "upper", ((F.col("lower") + F.col("upper")) / 2).alias("mid_age"))
