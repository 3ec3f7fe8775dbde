"""Operator 2: graded toxicity by cumulative-link ordinal regression on sparse text features.

P(severity <= k) = sigmoid(threshold_k - x.w): one weight vector shared by all ordered thresholds. Features are a text's
distinct lower-case words and their first four and five letters, hashed to 63 bits; places of a single row and places
no more frequent in toxic rows than in others are left out, the penalties choose among the rest. The model is fitted in
one task on a bounded sample of labelled rows (``max_per_class`` of each label, chosen by a hash of the id); its weights
are broadcast and every text is scored whole.

The label table says toxic or not. Severity grades for toxic rows come from the sample: the number of features that
only toxic rows have decides between grade 1 (up to the median) and grade 2 (above it). ``fit`` itself takes any grades.

Cases: null or empty text has no features; labels without a text or with a null label are left out of the sample; without
rows of both classes, or without a telling feature, nothing is rejected; repeated rows are scored each; an empty table
gives an empty result; other columns pass through ``drop_toxic`` and are ignored by ``score_toxicity``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandloom.llm._shared import discard, settled, table

#: Letters, digits and bytes above 127 stay; all else parts words.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _distinct_words(text: str | None) -> set[bytes]:
    return set(text.lower().encode().translate(_FOLD).split()) if text else set()


def _place(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) >> 1


def _places(word: bytes) -> list[int]:
    out = [_place(word)]
    if len(word) > 4:
        out += [_place(b"^4" + word[:4]), _place(b"^5" + word[:5])]
    return out


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: float) -> list[float]:
        """P(severity >= k) for k = 1, 2, ..."""
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def telling(rows: list[np.ndarray], positive: np.ndarray, least_rows: int = 2) -> np.ndarray:
    """The places that ``least_rows`` rows hold and that a larger share of the positive rows holds than of the others. No bar
    moves with the number of labels, so what marks a small group (a language with few labels) reaches the fit as well."""
    n = [max(1, int((~positive).sum())), max(1, int(positive.sum()))]
    apart = [np.unique(r) for r in rows]
    sizes = np.array([len(r) for r in apart])
    flat = np.concatenate(apart)
    names = np.unique(flat)
    inverse = np.searchsorted(names, flat)
    del flat, apart
    held = [np.bincount(inverse[np.repeat(positive == c, sizes)], minlength=len(names)) for c in (False, True)]
    return names[(held[0] + held[1] >= least_rows) & (held[1] * n[0] > held[0] * n[1])]


def fit(rows: list[np.ndarray], grades: np.ndarray, l2: float = 1e-3, l1: float = 1e-2, steps: int = 300, balance: bool = True) -> Model:
    """Adaptive gradient on the mean negative log-likelihood of the cumulative-link model (classes weigh alike if
    ``balance``) plus l2/2 * w^2 + l1 * |w|, over the places that ``telling`` gives; the penalties decide
    which of them count."""
    top = int(grades.max(initial=0))
    if len(rows) == 0 or len(set(grades.tolist())) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(max(1, top), 1e9))
    places = telling(rows, grades > 0)
    n, d = len(rows), len(places)
    if not d:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(top, 1e9))
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    at = np.searchsorted(places, flat).clip(max=d - 1)
    keep = places[at] == flat
    row, col = np.repeat(np.arange(n), sizes)[keep], at[keep]
    del flat, at, keep  # the steps below need the memory
    weight = np.full(n, 1 / n) if not balance else 1 / (len(set(grades.tolist())) * np.bincount(grades, minlength=top + 1)[grades])

    def slopes(w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.bincount(row, w[col], n)
        below = _sigmoid(theta[grades.clip(max=top - 1)] - score)
        below[grades == top] = 1.0
        under = _sigmoid(theta[(grades - 1).clip(min=0)] - score)
        under[grades == 0] = 0.0
        inside = np.maximum(below - under, 1e-12)
        g_theta = np.zeros(top)
        low, high = grades < top, grades > 0
        np.add.at(g_theta, grades[low], -(weight * below * (1 - below) / inside)[low])
        np.add.at(g_theta, grades[high] - 1, (weight * under * (1 - under) / inside)[high])
        return np.bincount(col, (-weight * (below + under - 1))[row], d) + l2 * w, g_theta

    # adaptive moments over weights and thresholds together; the rate falls to a tenth
    x = np.concatenate([np.zeros(d), np.linspace(0.0, 1.0, top)])
    first, second = np.zeros(d + top), np.zeros(d + top)
    for i in range(1, steps + 1):
        g = np.concatenate(slopes(x[:d], x[d:]))
        g[:d] += l1
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        rate = 0.05 * 0.1 ** (i / steps)
        x = x - rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
        x[:d] = np.maximum(x[:d], 0)  # evidence of severity only adds up
        x[d:] = np.maximum.accumulate(x[d:] + 1e-6 * np.arange(top))
    w, theta = x[:d], x[d:]
    used = np.flatnonzero(w)
    return Model(places[used], w[used], theta)


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_per_class: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``max_per_class`` rows of each label. The sample's ids (bounded by it) are broadcast to the texts."""
    ids = labels.select(F.col(id_col).cast("long").alias("s_id"), F.col(label_col).cast("int").alias("s_label")).where("s_id is not null and s_label in (0, 1)").dropDuplicates(["s_id"])
    parts = [ids.where(F.col("s_label") == y).orderBy(F.xxhash64("s_id"), "s_id").limit(max_per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).collect()  # at most 2 * max_per_class rows
    spark = docs.sparkSession
    small = spark.createDataFrame([(r["s_id"], r["s_label"]) for r in chosen], "s_id long, s_label int")
    joined = docs.select(F.col(id_col).cast("long").alias("s_id"), F.col(text_col).cast("string").alias("s_text")).join(F.broadcast(small), "s_id")
    # of texts that share an id, the one of least hash
    joined = joined.groupBy("s_id", "s_label").agg(F.min_by("s_text", F.xxhash64("s_text")).alias("s_text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            words = [sorted(_distinct_words(t.as_py())) for t in get("s_text")]
            every = [[p for w in x for p in _places(w)] for x in words]
            yield pa.RecordBatch.from_arrays([get("s_id"), get("s_label"), pa.array(every, pa.list_(pa.int64()))], names=["s_id", "s_label", "every"])

    sample = settled(joined.select("s_id", "s_label", "s_text").mapInArrow(features, "s_id long, s_label int, every array<long>"), "labelled")
    n = {r["s_label"]: r["n"] for r in sample.groupBy("s_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return fit([], np.zeros(0, np.int64))
    # the driver gets the features that can tell, and of each row of the sample those alone
    held = sample.select("s_label", F.explode(F.array_distinct("every")).alias("place")).groupBy("place").agg(F.count_if(F.col("s_label") == 0).alias("clean"), F.count_if(F.col("s_label") == 1).alias("toxic"))
    can = held.where((F.col("clean") + F.col("toxic") >= 2) & (F.col("toxic") * n[0] > F.col("clean") * n[1])).select("place")
    places = np.sort(can.toArrow().column("place").to_numpy().astype("<i8"))
    sent = spark.sparkContext.broadcast(places.tobytes())

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, "<i8")
        for batch in batches:
            every = [np.asarray(v.values).astype("<i8") for v in batch.column(2)]
            at = [np.searchsorted(known, x).clip(max=max(len(known) - 1, 0)) for x in every]
            kept = [x[known[i] == x] if len(known) else x[:0] for x, i in zip(every, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in kept], pa.binary())], names=["s_id", "s_label", "every"])

    def train(got: pa.Table) -> pa.Table:
        got = got.sort_by("s_id")
        every = [np.frombuffer(x.as_buffer(), "<i8") for x in got.column("every")]
        model = fit(every, severity(every, np.asarray(got.column("s_label")).astype(np.int64)))
        return pa.table({c: pa.array([getattr(model, c).tolist()], pa.list_(t)) for c, t in (("places", pa.int64()), ("weights", pa.float64()), ("thresholds", pa.float64()))})

    # the sample is bounded, so one task fits; the driver gets the model alone
    told = sample.mapInArrow(narrow, "s_id long, s_label int, every binary").groupBy(F.lit(0).alias("whole"))
    row = told.applyInArrow(train, "places array<long>, weights array<double>, thresholds array<double>").first()
    discard(sample)
    return Model(np.array(row["places"], np.int64), np.array(row["weights"], np.float64), np.array(row["thresholds"], np.float64))


def severity(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades of a sample: 0 for clean rows; toxic rows by how many of their features three or more toxic rows and no clean
    row hold: 1 up to the median of toxic rows, 2 above it."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    names = np.unique(flat)
    inverse = np.searchsorted(names, flat)  # in less memory than by the sort's own inverse
    del flat
    y = np.repeat(toxic == 1, sizes)
    marked = (np.bincount(inverse[y], minlength=len(names)) >= 3) & (np.bincount(inverse[~y], minlength=len(names)) == 0)
    many = np.bincount(np.repeat(np.arange(len(rows)), sizes), marked[inverse], len(rows))
    return np.where(toxic == 0, 0, np.where(many > np.median(many[toxic == 1]), 2, 1))


class Scorer:
    """Scores texts with a model; the weight of a word with its prefixes is looked up once a task."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most = model, most
        self.by_place = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
        self.known: dict[bytes, float] = {}

    def score(self, text: str | None) -> float:
        known, out = self.known, []
        for w in _distinct_words(text):
            x = known.get(w)
            if x is None:
                if len(known) >= self.most:
                    known.clear()
                x = known[w] = sum(self.by_place.get(p, 0.0) for p in _places(w))
            if x:
                out.append(x)
        return math.fsum(out)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade (most likely), toxic (P(severity >= 1) of one half or more); a row for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            above = [scorer.model.probabilities(scorer.score(t.as_py())) for t in batch.column(1)]
            grades = []
            for a in above:
                steps = [1.0, *a, 0.0]
                chance = [steps[i] - steps[i + 1] for i in range(len(steps) - 1)]
                grades.append(chance.index(max(chance)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([round(sum(a), 6) for a in above], pa.float64()), pa.array(grades, pa.int32()), pa.array([a[0] >= 0.5 for a in above], pa.bool_())],
                names=["doc_id", "expected_severity", "grade", "toxic"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(go, "doc_id long, expected_severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.model.probabilities(scorer.score(t.as_py()))[0] < 0.5 for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(go, docs.schema)


def query_op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_on_labels(docs, table(spark, sf_dir, "labels")))
