"""Merkle manifest of a table of documents by time-forward processing.

Every row is a leaf. The leaves of a source, in order, form a tree of runs of ``ARITY``; the sources' roots form another tree,
whose root stands for the table. Nodes are labelled (last leaf below, level), so that children precede their parents. A forward
sweep takes nodes by rising label: a node's digest goes as a message to its parent's label into a priority queue, and a parent is
worked off when its label comes up. A sweep by falling label returns: the root's message is empty, and every node hands to
each child the siblings on the path and a link to its own message, until leaves hold their whole proofs.

The queue is external: Spark's shuffle sorts the labels of all nodes, and what waits in a task's heap is a path's messages (a few
a level). Blocks of ``ARITY ** levels`` consecutive leaves are swept alike and independently; their roots are the leaves of the
next tier, so no task holds a tree, a source or all digests, and a source with most of the rows is many blocks.

Defined results. Null fields are written ``-``; a null text is not an empty one. A null source is a source of its own, before all
others. Leaves of one doc_id follow by digest, null ids first; equal rows keep a place each, in any order (they have equal
digests). A null id is never tampered with. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandloom.llm._shared import discard, settled, table

ARITY = 3
#: Levels that one sweep of a block takes: 3^8 = 6561 leaves a block.
LEVELS = 8
#: Level of the message that a block's top gets from the tier above.
_ABOVE = 127
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[written(c) for c in fields]), 256)


def tree_height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    h, span = 0, 1
    while span < n:
        h, span = h + 1, span * ARITY
    return h


# -- places of the leaves --------------------------------------------------------------------------------------------
def _count_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows of each group inside a sorted partition; ``part`` rises with the order."""
    part, last, done = TaskContext.get().partitionId(), None, 0
    for pdf in frames:
        if not len(pdf):
            continue
        group = pdf["grp"].to_numpy(object)
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        local = np.arange(len(pdf)) - np.repeat(begin, np.diff(np.r_[begin, len(pdf)]))
        if group[0] == last:
            local[: begin[1] if len(begin) > 1 else len(pdf)] += done
        last, done = group[-1], int(local[-1]) + 1
        yield pdf.assign(part=np.int32(part), local=local.astype(np.int64))


def placed(rows: DataFrame, order: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``pos`` from 0 inside their group ``grp`` and the group's size ``n``, the written table to discard).

    Rows are dealt by ranges of (grp, *order), numbered as they stand in their partition, and moved by the sizes of the group's
    earlier partitions; a group is as many tasks as it has ranges."""
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in ("grp", *order)]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("grp", *order)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    local = settled(ranged.mapInPandas(_count_runs, f"{schema}, part int, local long"), label)
    sizes = local.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("grp")
    base = sizes.select("grp", "part", (F.sum("m").over(whole.orderBy("part")) - F.col("m")).alias("base"), F.sum("m").over(whole).alias("n"))
    return local.join(base, ["grp", "part"]).withColumn("pos", F.col("local") + F.col("base")).drop("part", "local", "base"), local


# -- forward: digests to parents -------------------------------------------------------------------------------------
_NODES = "grp string, block long, last long, level int, kids array<string>, digest string, top boolean, n long"
_NODES_ARROW = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("last", pa.int64()), ("level", pa.int32()), ("kids", pa.list_(pa.string())), ("digest", pa.string()), ("top", pa.bool_()), ("n", pa.int64())])


class _Climb:
    """The forward sweep of one block of ``size`` leaves up to ``height`` levels."""

    def __init__(self, size: int, height: int):
        self.size, self.height, self.queue = size, height, []

    def send(self, level: int, index: int, value: str) -> None:
        above = index // ARITY
        last = min((above + 1) * ARITY ** (level + 1), self.size) - 1
        heapq.heappush(self.queue, (last, level + 1, index, value))

    def due(self, before: int) -> Iterator[tuple[int, int, list[str], str]]:
        """Work off the inner nodes whose last leaf lies before ``before``: (last, level, digests of the children, digest)."""
        queue = self.queue
        while queue and queue[0][0] < before:
            last, level, index, value = heapq.heappop(queue)
            kids = [value]
            while queue and queue[0][:2] == (last, level):
                kids.append(heapq.heappop(queue)[3])
            own = digest(*kids)
            yield last, level, kids, own
            if level < self.height:
                self.send(level, index // ARITY, own)


def _climber(levels: int):
    span = ARITY**levels

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, climb, rows = None, None, []

        def finish(before: int) -> None:
            for last, level, kids, own in climb.due(before):
                rows.append((*key[:2], last, level, kids, own, level == climb.height, key[2]))

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NODES_ARROW.types, strict=True)], schema=_NODES_ARROW)
            rows.clear()
            return got

        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "block", "pos", "n", "digest")}
            for group, block, pos, n, value in zip(*columns.values(), strict=True):
                if key is None or key[:2] != (group, block):
                    if key is not None:
                        finish(span)
                    key, climb = (group, block, n), _Climb(min(span, n - block * span), min(levels, tree_height(n)))
                at = pos - block * span
                finish(at)
                if climb.height:
                    climb.send(0, at, value)
                else:
                    rows.append((group, block, at, 0, [], value, True, n))
            if rows:
                yield out()
        if key is not None:
            finish(span)
        if rows:
            yield out()

    return sweep


def climb(leaves: DataFrame, levels: int, label: str) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame | None]:
    """Tiers of (leaves, inner nodes), lowest first, and one top (grp, digest) a group; ``leaves``: grp, pos, n, digest."""
    span, tiers, now = ARITY**levels, [], leaves
    most = leaves.agg(F.max("n")).first()[0]
    while most:
        keyed = now.select("grp", F.floor(F.col("pos") / span).alias("block"), "pos", "n", "digest")
        nodes = settled(keyed.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInArrow(_climber(levels), _NODES), label)
        tiers.append((now, nodes))
        now = nodes.where("top").select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / span).alias("n"), "digest")
        if most <= span:
            return tiers, now.select("grp", "digest")
        most = -(-most // span)
    return tiers, None


# -- backward: proofs to leaves --------------------------------------------------------------------------------------
_SENT = "grp string, pos long, doc_id long, leaf string, other string, subroot string, root string, proof array<string>"
_SENT_ARROW = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("other", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.string()))])


def fold(leaf: str, proof: Sequence[str]) -> str:
    """The root over ``leaf``; a step of a proof is the place in the run (a digit) and the run's other digests in their order."""
    for step in proof:
        at = 1 + 64 * int(step[0])
        leaf = digest(step[1:at], leaf, step[at:])
    return leaf


def _descender(levels: int):
    span = ARITY**levels

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queue, named = None, [], (None, None)
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "block", "last", "level", "kids", "n", "doc_id", "leaf", "other", "subroot", "root")}
            rows = []
            for group, block, last, level, kids, n, doc_id, leaf, other, subroot, root in zip(*columns.values(), strict=True):
                if key != (group, block):
                    key, queue, named = (group, block), [], (subroot, root)
                    size, height = min(span, n - block * span), min(levels, tree_height(n))
                    # what the tier above sent, for the top's label
                    queue.append((1 - size, -height, (kids, None)))
                    continue
                _, _, link = heapq.heappop(queue)
                if level:
                    index = last // ARITY**level
                    for slot, _ in enumerate(kids):
                        below = index * ARITY + slot
                        step = f"{slot}{''.join(kids[:slot])}{''.join(kids[slot + 1 :])}"
                        heapq.heappush(queue, (1 - min((below + 1) * ARITY ** (level - 1), size), 1 - level, (step, link)))
                    continue
                proof = []
                while link[1] is not None:
                    proof.append(link[0])
                    link = link[1]
                rows.append((group, block * span + last, doc_id, leaf, other, *named, proof + link[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SENT_ARROW.types, strict=True)], schema=_SENT_ARROW)

    return sweep


def descend(tiers: Sequence[tuple[DataFrame, DataFrame]], sent: DataFrame, levels: int, label: str) -> DataFrame:
    """Leaves of the lowest tier with their proofs. ``sent``: what each group's top is sent (grp, subroot, root, proof)."""
    span = ARITY**levels
    null = lambda t: F.lit(None).cast(t)
    above = sent.select("grp", F.lit(0).cast("long").alias("pos"), "subroot", "root", "proof")
    for at in range(len(tiers) - 1, -1, -1):
        leaves, nodes = tiers[at]
        payload = [F.col(c) if c in leaves.columns else null(t).alias(c) for c, t in (("doc_id", "long"), ("digest", "string"), ("other", "string"))]
        block = F.floor(F.col("pos") / span).alias("block")
        # a block's size comes with its message: any of its rows knows the group's
        sizes = nodes.where("top").select("grp", "block", "n")
        messages = above.withColumnRenamed("pos", "block").join(sizes, ["grp", "block"])
        stream = (
            messages.select("grp", "block", F.lit(span).cast("long").alias("last"), F.lit(_ABOVE).alias("level"), F.col("proof").alias("kids"), "n", null("long").alias("doc_id"), null("string").alias("leaf"), null("string").alias("other"), "subroot", "root")
            .unionByName(nodes.where("level > 0").select("grp", "block", "last", "level", "kids", "n", null("long").alias("doc_id"), null("string").alias("leaf"), null("string").alias("other"), null("string").alias("subroot"), null("string").alias("root")))
            .unionByName(leaves.select("grp", block, (F.col("pos") - F.floor(F.col("pos") / span) * span).alias("last"), F.lit(0).alias("level"), null("array<string>").alias("kids"), "n", payload[0], payload[1].alias("leaf"), payload[2], null("string").alias("subroot"), null("string").alias("root")))
        )
        swept = stream.repartition("grp", "block").sortWithinPartitions("grp", "block", F.desc("last"), F.desc("level")).mapInArrow(_descender(levels), _SENT)
        above = settled(swept, label) if at else swept
    return above


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, other, subroot, root, proof for every row of ``docs``: its digest, the digest after tampering, its group's root,
    the root of all, and the steps of its proof, leaf first (see :func:`fold`). ``fields`` are hashed in their order; where
    ``tampered`` (a condition) holds, ``other`` is the digest without the newlines of ``text_col``, else it is the leaf."""
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))
    changed = leaf_digest([F.translate(F.col(c).cast("string"), "\n", "") if c == text_col else F.col(c) for c in fields])
    leaf = leaf_digest([F.col(c) for c in fields])
    other = leaf if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), changed).otherwise(leaf)
    hashed = settled(docs.select(group.alias("grp"), F.col(id_col).cast("long").alias("doc_id"), leaf.alias("digest"), other.alias("other")).withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves, kept = placed(hashed, ["doc_id", "digest", "row"], "placed")
    discard(hashed)
    leaves = leaves.drop("row")
    tiers, tops = climb(leaves, levels, "nodes")
    if tops is None:
        return kept.select("doc_id", F.col("digest").alias("leaf"), "other", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array("digest").alias("proof"))
    roots, kept_roots = placed(tops.select(F.lit("all").alias("grp"), F.col("grp").alias("other"), "digest"), ["other"], "sources")
    upper, top = climb(roots, levels, "upper")
    sent = descend(upper, top.select("grp", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<string>").alias("proof")), levels, "sent")
    # a source's own name travelled as the payload of its leaf in the upper tree, its subroot as the leaf
    sent = settled(sent.select(F.col("other").alias("grp"), F.col("leaf").alias("subroot"), "root", "proof"), "sent")
    discard(kept_roots)
    return descend(tiers, sent, levels, "sent").select("doc_id", "leaf", "other", "subroot", "root", "proof")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, others, roots = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("proof", "other", "root"))
        folded = [fold(leaf, proof) for leaf, proof in zip(others, proofs, strict=True)]
        sums = [digest(*[step[1:] for step in proof]) for proof in proofs]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "leaf", "subroot", "root")]
        verified = pa.array([a == b for a, b in zip(folded, roots, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.string()), pa.array(folded, pa.string()), verified], names=_CHECKED_NAMES)


_CHECKED_NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def query_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    types = ["long", "string", "string", "string", "string", "string", "boolean"]
    return merkle_manifest(docs, tampered=even).mapInArrow(_check, ", ".join(f"{n} {t}" for n, t in zip(_CHECKED_NAMES, types, strict=True)))


def _written_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


_LEAF = " || ".join(_written_sql(c) for c in FIELDS)
_TAMPERED = " || ".join(_written_sql("replace(text, chr(10), '')" if c == "text" else c) for c in FIELDS)
SQL_OP11 = f"""
WITH RECURSIVE bits(i, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
raw AS (SELECT row_number() OVER () AS rid, doc_id, source, sha256({_LEAF}) AS leaf, sha256({_TAMPERED}) AS changed, doc_id::VARCHAR AS s FROM documents),
crc(rid, s, c) AS (SELECT rid, s, 4294967295::BIGINT FROM raw WHERE doc_id IS NOT NULL UNION ALL SELECT rid, s[2:], xor(c >> 8, t[(xor(c, ascii(s[1])::BIGINT) & 255) + 1]) FROM crc, tab WHERE s <> ''),
d AS (SELECT raw.rid, doc_id, source, leaf, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN changed ELSE leaf END AS other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, raw.rid) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM raw LEFT JOIN (SELECT * FROM crc WHERE s = '') e ON raw.rid = e.rid),
up(source, lvl, pos, n, h) AS (SELECT source, 0, pos, n, leaf FROM d UNION ALL SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
subs AS (SELECT source, lvl AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
upper(lvl, pos, n, h) AS (SELECT 0, pos, n, subroot FROM subs UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3, n),
steps AS (SELECT d.rid, up.lvl, up.pos, up.h, up.pos = d.pos // (3 ** up.lvl)::BIGINT AS own FROM d JOIN up ON d.source IS NOT DISTINCT FROM up.source AND up.n > 1 AND up.pos // 3 = d.pos // (3 ** (up.lvl + 1))::BIGINT
UNION ALL SELECT d.rid, s.height + u.lvl, u.pos, u.h, u.pos = s.pos // (3 ** u.lvl)::BIGINT FROM d JOIN subs s ON d.source IS NOT DISTINCT FROM s.source JOIN upper u ON u.n > 1 AND u.pos // 3 = s.pos // (3 ** (u.lvl + 1))::BIGINT),
proofs AS (SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY lvl, pos) FILTER (NOT own), '')) AS proof_sha256, max(lvl) + 1 AS top FROM steps GROUP BY rid),
runs AS (SELECT rid, lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < mine), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > mine), '') AS b FROM (SELECT *, max(pos) FILTER (own) OVER (PARTITION BY rid, lvl) AS mine FROM steps) GROUP BY rid, lvl),
folds(rid, lvl, h) AS (SELECT rid, 0, other FROM d UNION ALL SELECT f.rid, f.lvl + 1, sha256(a || f.h || b) FROM folds f JOIN runs r ON f.rid = r.rid AND f.lvl = r.lvl)
SELECT doc_id, leaf, subroot, r.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folds.h AS folded_root, folds.h = r.h AS verified
FROM d JOIN subs ON d.source IS NOT DISTINCT FROM subs.source JOIN (SELECT h FROM upper WHERE n = 1) r ON true LEFT JOIN proofs ON d.rid = proofs.rid JOIN folds ON folds.rid = d.rid AND folds.lvl = coalesce(top, 0)
"""
