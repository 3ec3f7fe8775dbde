"""Genealogies made of the event table, and the queries over them with recursive DuckDB SQL.

A user is a sample: six leaves of two species under five inner nodes, whose tree changes at every quarter of the coordinate; a
quarter's tree is a ladder or balanced over a rotation of the leaves. Every event is a mutation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators import genealogy as Y
from strandloom.plans.catalog import _t, query, r6

#: (parent, child) by shape; children below 6 are places in the rotation of the leaves.
_SHAPES = {
    0: [(6, 0), (6, 1), (7, 6), (7, 2), (8, 7), (8, 3), (9, 8), (9, 4), (10, 9), (10, 5)],
    1: [(6, 0), (6, 1), (7, 2), (7, 3), (8, 4), (8, 5), (9, 6), (9, 7), (10, 9), (10, 8)],
}
_KEYS = "user_id % 3 AS run, 'r' || user_id % 10 AS region, user_id AS sample_idx"


def genealogies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mutations, sites, leaves)."""
    events = _t(spark, d, "events")
    key = [(F.col("user_id") % 3).alias("run"), F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("region"), F.col("user_id").alias("sample_idx")]
    users = events.select("user_id").distinct()
    nodes = users.select("user_id", *key, F.explode(F.sequence(F.lit(0), F.lit(10))).alias("n")).select(
        "run", "region", "sample_idx", F.col("n").cast("long").alias("node_id"), F.when(F.col("n") < 6, 0.0).otherwise(10.0 * F.floor(F.col("n") / 2) + F.col("user_id") % 7).alias("time")
    )
    shape = lambda k: F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c in _SHAPES[k]])
    quarters = users.select("user_id", *key, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    pairs = quarters.withColumn("e", F.explode(F.when((F.col("user_id") + F.col("q")) % 2 == 0, shape(0)).otherwise(shape(1))))
    turned = (F.col("e.c") + F.col("user_id") + F.col("q") * (1 + F.col("user_id") % 5)) % 6
    edges = pairs.select("run", "region", "sample_idx", (F.col("q") * 250.0).alias("left"), ((F.col("q") + 1) * 250.0).alias("right"), F.col("e.p").cast("long").alias("parent"), F.when(F.col("e.c") < 6, turned).otherwise(F.col("e.c")).cast("long").alias("child"))
    tops = quarters.select("run", "region", "sample_idx", (F.col("q") * 250.0).alias("left"), ((F.col("q") + 1) * 250.0).alias("right"), F.lit(-1).cast("long").alias("parent"), F.lit(10).cast("long").alias("child"))
    mutations = events.select(*key, (F.col("event_id") % 1000).cast("double").alias("position"), F.floor(F.col("event_id") * 7 / 3 % 11).cast("long").alias("node"), F.substring("event_type", 1, 1).alias("derived_state"), (F.pmod(F.col("event_id"), F.lit(100)) / 100).alias("freq"))
    sites = mutations.select("region", F.lit("1").alias("chrom"), F.col("position").cast("long").alias("pos")).distinct()
    leaves = spark.range(6).select(F.col("id").alias("node_id"), F.floor(F.col("id") / 3).cast("int").alias("species"))
    return nodes, edges.unionByName(tops), mutations, sites, leaves


_EDGE_ROWS = ", ".join(f"({k}, {p}, {c})" for k, pairs in _SHAPES.items() for p, c in pairs)
_TREES = f"""
us AS (SELECT DISTINCT user_id FROM events), shapes(k, p, c) AS (VALUES {_EDGE_ROWS}),
raw AS (SELECT user_id, {_KEYS}, n.range AS node, CASE WHEN n.range < 6 THEN 0 ELSE 10 * (n.range // 2) + user_id % 7 END::DOUBLE AS t FROM us, range(11) n),
nd AS (SELECT user_id, run, region, sample_idx, node, CASE WHEN t > 0 THEN max(CASE WHEN t > 0 THEN t - node * 1e-4 END) OVER (PARTITION BY user_id ORDER BY node) + node * 1e-4 ELSE 0 END AS time FROM raw),
ed AS (SELECT user_id, q.range AS q, p AS parent, CASE WHEN c < 6 THEN (c + user_id + q.range * (1 + user_id % 5)) % 6 ELSE c END AS child FROM us, range(4) q, shapes WHERE k = (user_id + q.range) % 2),
mu AS (SELECT user_id, {_KEYS}, event_id % 1000 AS pos, event_id % 1000 // 250 AS q, floor(event_id * 7 / 3 % 11)::BIGINT AS node, event_type[1] AS s, event_id % 100 / 100 AS freq FROM events)
"""


@query(f"""WITH RECURSIVE {_TREES},
lv(user_id, q, node, leaf) AS (SELECT user_id, q, child, child FROM ed WHERE child < 6 UNION ALL SELECT ed.user_id, ed.q, ed.parent, leaf FROM lv JOIN ed ON ed.user_id = lv.user_id AND ed.q = lv.q AND ed.child = lv.node),
sp AS (SELECT user_id, q, node, min(leaf // 3) AS lo, max(leaf // 3) AS hi FROM lv GROUP BY ALL),
bt AS (SELECT user_id, q, parent AS node, bool_and(lo = hi) AND count(DISTINCT lo) = 2 AS splits FROM ed JOIN sp USING (user_id, q) WHERE sp.node = ed.child GROUP BY ALL),
br AS (SELECT n.user_id, q.range AS q, n.node, n.time, e.parent, (n.time + p.time) / 2 AS mid, coalesce(splits, false) AS splits FROM nd n CROSS JOIN range(4) q LEFT JOIN ed e ON e.user_id = n.user_id AND e.q = q.range AND e.child = n.node LEFT JOIN nd p ON p.user_id = n.user_id AND p.node = e.parent LEFT JOIN bt ON bt.user_id = n.user_id AND bt.q = q.range AND bt.node = n.node),
ok AS (SELECT br.*, mid IS NOT NULL AND (SELECT count(*) FROM nd WHERE nd.user_id = br.user_id AND nd.time > mid) <= 2 AS few FROM br),
rk AS (SELECT mu.*, time, parent IS NOT NULL AS nonroot, mid, splits, few, row_number() OVER (PARTITION BY mu.user_id, pos ORDER BY time DESC, mu.node, s) AS k, count(*) OVER (PARTITION BY mu.user_id, pos) AS n_mut FROM mu JOIN ok ON ok.user_id = mu.user_id AND ok.q = mu.q AND ok.node = mu.node),
one AS (SELECT a.*, (SELECT count(*) FROM rk b WHERE b.user_id = a.user_id AND b.pos = a.pos AND b.s = a.s) AS fwd FROM rk a WHERE k = 1),
tw AS (SELECT one.run, one.region, one.sample_idx, one.pos, one.n_mut, fwd, one.time AS oldest_age, one.nonroot, one.nonroot AND one.few AND one.splits AS first, NOT one.nonroot AND two.k IS NOT NULL AND two.nonroot AND two.few AND two.splits AS second, NOT one.nonroot AND two.k IS NOT NULL AS other,
one.time AS t1, one.mid AS m1, one.few AS f1, one.splits AS s1, two.time AS t2, two.mid AS m2, two.few AS f2, two.splits AS s2, one.user_id, one.q FROM one LEFT JOIN rk two ON two.user_id = one.user_id AND two.pos = one.pos AND two.k = 2)
SELECT run, region, sample_idx, '1' AS chrom, pos, n_mut, fwd AS n_fwd, n_mut - fwd AS n_rev, round(oldest_age, 6) AS oldest_age, CASE WHEN other THEN s2 ELSE s1 END AS coalesce_ok, CASE WHEN other THEN f2 ELSE f1 END AS nodes_ok, nonroot, first, second,
bt.splits AS yellow, round(CASE WHEN other THEN t2 ELSE t1 END, 6) AS node_age, round(CASE WHEN other THEN m2 ELSE m1 END, 6) AS branch_midpoint FROM tw JOIN bt ON bt.user_id = tw.user_id AND bt.q = tw.q AND bt.node = 9""")
def topology_metrics(spark, d):
    """Verdicts of the local tree at every site of every sample, swept along the sample's sites."""
    out = Y.topology_metrics(*genealogies(spark, d))
    return out.select(*[r6(c, c) if t == "double" else c for c, t in out.dtypes])


@query(f"WITH {_TREES} SELECT run, region, sample_idx, node AS node_id, round(time, 6) AS time FROM nd")
def clean_genealogy(spark, d):
    nodes, edges, *_ = genealogies(spark, d)
    return Y.clean_genealogy(nodes, edges)[0].withColumn("time", r6("time"))


@query(f"WITH {_TREES} SELECT user_id % 3 AS run, 'r' || user_id % 10 AS region, user_id AS sample_idx, q * 250.0::DOUBLE AS \"left\", parent::BIGINT AS parent, child FROM ed")
def clean_edges(spark, d):
    return Y.clean_edges(genealogies(spark, d)[1]).drop("right")


@query(f"""WITH {_TREES} SELECT mu.run, mu.region, mu.sample_idx, pos::DOUBLE AS position, mu.node, round(n.t, 6) AS lower, round(p.t, 6) AS upper, round((n.t + p.t) / 2, 6) AS mid_age FROM mu JOIN ed ON ed.user_id = mu.user_id AND ed.q = mu.q AND ed.child = mu.node
JOIN raw n ON n.user_id = mu.user_id AND n.node = mu.node JOIN raw p ON p.user_id = mu.user_id AND p.node = ed.parent WHERE freq >= 0.05""")
def branch_ages(spark, d):
    nodes, edges, mutations, *_ = genealogies(spark, d)
    return Y.branch_ages(nodes, edges, mutations, 0.05).withColumns({c: r6(c) for c in ("lower", "upper", "mid_age")})
