"""Operator 5: secrets by rules over a trigram inverted index; DataFrame functions only.

From every rule's regular expression follows a Boolean query over trigrams: any match must hold, for one of the
alternatives, all of its trigrams. The index holds postings (trigram, document) of the trigrams that queries name;
intersecting them per alternative gives each rule's candidates, and only those are matched against the rule. A rule without
a mandatory trigram (long hexadecimal runs) reads every text.

Base kinds: assign, access, hex. Added kinds: pem (private key headers), github, slack, jwt. Spans are code points, end
exclusive, and found with built-in functions: matches and the pieces between them give the positions by their lengths.

Cases: a null or empty text has no spans; texts are read whole; repeated rows are reported each; rows that share an id but
not a text are told apart; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm._shared import table


@dataclass(frozen=True)
class Rule:
    """``pattern``: what is matched, leftmost and non-overlapping; a match is kept if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = (
    Rule("assign", _ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the maximal runs of 24 and more: what [0-9a-f]+ finds and the length keeps
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,200}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE_KINDS = ("assign", "access", "hex")
#: Matches in a stretch of the span walk.
STRETCH = 64


def literal_runs(pattern: str) -> list[list[str]]:
    """For each alternative of a match, the lower-case literal strings that it must hold (in any place)."""
    from re import _constants as c, _parser

    def walk(items) -> list[list[str]]:
        alternatives = [[""]]  # of each: runs so far, the last one open

        def cut() -> None:
            for a in alternatives:
                a.append("")  # even if the run is empty: what a class opens or closes never joins its neighbours

        for op, arg in items:
            if op is c.LITERAL:
                for a in alternatives:
                    a[-1] += chr(arg).lower()
            elif op in (c.SUBPATTERN, c.BRANCH):
                choices = [x for part in arg[1] for x in walk(part)] if op is c.BRANCH else walk(arg[3])
                joined = []
                for a in alternatives:
                    for x in choices:
                        joined.append([*a[:-1], a[-1] + x[0], *x[1:]])
                alternatives = joined
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
                low, high, inner = arg
                if low == 0 and high == 1 and len(inner) == 1:  # an optional part: with and without
                    alternatives = [[*a[:-1], a[-1] + x[0], *x[1:]] for a in alternatives for x in walk(inner)] + [list(a) for a in alternatives]
                elif low == high == 1:
                    alternatives = [[*a[:-1], a[-1] + x[0], *x[1:]] for a in alternatives for x in walk(inner)]
                elif low >= 1 and len(inner) == 1 and inner[0][0] is c.LITERAL:
                    for a in alternatives:
                        a[-1] += chr(inner[0][1]).lower() * low
                    if high != low:
                        cut()
                else:
                    cut()
            elif op is not c.AT:
                cut()
        return alternatives

    return walk(_parser.parse(pattern))


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives, each a list of trigrams that must all occur; empty if some alternative has none (scan fully)."""
    query = []
    for runs in literal_runs(pattern):
        grams = sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})
        if not grams:
            return []
        if grams not in query:
            query.append(grams)
    return [q for q in query if not any(set(p) < set(q) for p in query)]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def walk(lengths: Column, kind: str) -> Column:
    """array<struct<kind,start,end>> from the lengths (p before a match, m of it) along a text. Appending copies what there is,
    so spans are made in stretches of ``STRETCH`` matches, each from 0 on, and moved by the stretches' running total."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        return F.struct((start + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["m"]).alias("end")))).alias("out"))

    def stretches(ls: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(ls) - 1) / STRETCH).cast("int")))
        return F.transform(numbers, lambda i: F.aggregate(F.slice(ls, i * STRETCH + 1, STRETCH), F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step))

    def moved(parts: Column) -> Column:
        bases = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + part["at"])))
        based = F.zip_with(parts, F.slice(bases, F.lit(1), F.size(parts)), lambda part, base: F.struct(part["out"].alias("out"), base.alias("base")))
        return F.flatten(F.transform(based, lambda b: F.transform(b["out"], lambda s: F.struct(F.lit(kind).alias("kind"), (s["start"] + b["base"]).alias("start"), (s["end"] + b["base"]).alias("end")))))

    return let(lengths, lambda ls: let(stretches(ls), moved))


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<kind,start,end>> of a rule's kept matches, by lengths of matches and of the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1 if rule.group else 0))
    pieces = F.split(text, rule.pattern, -1)
    size = F.when(F.lit(rule.group == 0), F.transform(found, F.length)).otherwise(F.transform(kept, F.length))
    lengths = F.zip_with(F.transform(F.slice(pieces, 1, F.size(found)), F.length), F.transform(found, F.length), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    walked = walk(lengths, rule.kind)
    long_enough = F.filter(F.arrays_zip(walked.alias("span"), size.alias("size")), lambda z: z["size"] >= rule.least)
    return F.transform(long_enough, lambda z: z["span"]) if rule.least else walked


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(trigram, doc_id, text_key): one row for each trigram of ``grams`` that a text holds, in either case."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(F.explode(held).alias("trigram"), "doc_id", "text_key")


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(doc_id, text_key, kinds): the rules of which a document may hold a match."""
    spark = index.sparkSession
    terms = [(gram, kind, i, len(alt)) for kind, alts in queries.items() for i, alt in enumerate(alts) for gram in alt]
    wanted = F.broadcast(spark.createDataFrame(terms, "trigram string, kind string, alternative int, needed int"))  # a few rows a rule
    hits = index.join(wanted, "trigram").groupBy("doc_id", "text_key", "kind", "alternative").agg(F.count(F.lit(1)).alias("had"), F.max("needed").alias("needed"))
    return hits.where("had >= needed").groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found (array of kind, start, end, by start and then kind as the rules stand); one row for each row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    whole = [r for r in rules if r.kind not in queries]
    grams = sorted({g for q in queries.values() for alt in q for g in alt})
    # postings of rows that share id and text are the same; they count once
    index = postings(texts, grams).distinct()
    found = candidates(index, queries).withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"})
    joined = texts.join(found, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    parts = [matches(F.col("text"), r) for r in whole]
    parts += [F.when(F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind), matches(F.col("text"), r)).otherwise(none) for r in rules if r.kind in queries]
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    ranked = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", spans.alias("found"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def query_op5(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [count_of(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))
