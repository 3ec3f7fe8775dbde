"""Operator 1: personal data by anchor expansion.

One Aho-Corasick pass finds anchors in the whole text: at-signs, plus signs, digits, URL schemes and the cue words of
accounts and addresses. From each anchor a local parser expands to the left and right and validates what it
finds; text far from anchors is never parsed. All parsers are deterministic and linear in what they read.

Spans are (kind, start, end) in code points, end exclusive. Base kinds: email, ip, card, phone. Added kinds: url, account
(cue word and number, IBAN with its check digits, 3-2-4 digit numbers) and address (house number before a street word).

Cases: a null or empty text has no spans; very long texts are read whole, in one pass; rows that repeat are reported each;
an empty table gives an empty result; further columns pass through ``redact_pii`` and are ignored by ``find_pii``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm._shared import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "address")

_SCHEMES = ("http://", "https://", "ftp://")
_ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "customer id", "member id")
_STREET_WORDS = ("street", "avenue", "road", "boulevard", "lane", "drive", "straße", "calle", "rue")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[a-z]+://[^\s<>\"')\]]+")
_ACCOUNT = re.compile(r"[ ]?(?:number|no\.?|nr\.?|#)?[ ]?[:#=]?[ ]?([A-Z0-9][A-Z0-9-]{4,33})(?![A-Za-z0-9])", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
_THREE_TWO_FOUR = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_HOUSE = re.compile(r"[0-9]{1,5}[ ](?:[^\W\d_][\w.'-]*[ ]){0,3}$")
_WORDISH = re.compile(r"\w")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    anchors = {"@": "at", "+": "plus"} | {str(d): "digit" for d in range(10)} | dict.fromkeys(_SCHEMES, "scheme")
    for cue in _ACCOUNT_CUES:
        anchors |= dict.fromkeys((cue, cue.capitalize(), cue.upper()), "account")
    for word in _STREET_WORDS:
        anchors |= dict.fromkeys((word, word.capitalize()), "street")
    for text, kind in anchors.items():
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


class Parser:
    """Finds the spans of one text; holds the automaton so that a task builds it once."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
        email_to = ip_to = card_to = url_to = account_to = 0
        for last, (kind, size) in self.anchors.iter(text):
            at = last - size + 1
            if kind == "digit":
                if at >= card_to and (m := _CARD.match(text, at)):
                    card_to = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
                if at >= ip_to:
                    if m := _QUAD.match(text, at):
                        ip_to = m.end()
                        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.groups())):
                            out["ip"].append(m.span())
                    else:  # no later start in this run of digits can do better
                        ip_to = _DIGITS.match(text, at).end()
                if at >= account_to and (at == 0 or text[at - 1] not in "0123456789-") and (m := _THREE_TWO_FOUR.match(text, at)):
                    account_to = m.end()
                    out["account"].append(m.span())
            elif kind == "at":
                start = at
                while start > email_to and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_to = m.end()
                    out["email"].append((start, email_to))
            elif kind == "plus":
                if m := _PHONE.match(text, at):
                    if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                        out["phone"].append(m.span())
            elif kind == "scheme":
                if at >= url_to and (m := _URL.match(text, at)):
                    url_to = m.end()
                    out["url"].append(m.span())
            elif kind == "account":
                if at >= account_to and (at == 0 or not text[at - 1].isalnum()):
                    if (m := _IBAN.match(text, last + 2)) and _iban_ok(m[0]):
                        account_to = m.end()
                        out["account"].append(m.span())
                    elif (m := _ACCOUNT.match(text, last + 1)) and sum(c.isdigit() for c in m[1]) >= 5:
                        account_to = m.end()
                        out["account"].append(m.span(1))
            elif kind == "street":
                end = last + 1
                if (m := _HOUSE.search(text, max(0, at - 60), at)) and not (end < len(text) and _WORDISH.match(text[end])) and not (m.start() and text[m.start() - 1].isalnum()):
                    if not out["address"] or m.start() >= out["address"][-1][1]:
                        out["address"].append((m.start(), end))
        return [(kind, *span) for kind in KINDS for span in out[kind]]


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parser = Parser()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        found = [parser.spans(t.as_py() or "") for t in texts]
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found]
        base = [join_spans([s for s in x if s[0] in BASE_KINDS]) for x in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(spans, _SPAN_TYPE), pa.array([join_spans(x) for x in found]), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base])],
            names=["doc_id", "found", "spans", "base_sha256"],
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found (spans as structs), spans (joined), base_sha256; one row for each row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scan, f"doc_id long, found {_SPANS}, spans string, base_sha256 string")


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; other columns stay as they are.

    Overlapping spans become one mark named after the first. A null text stays null."""
    schema = docs.schema

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for t in batch.column(at):
                text = t.as_py()
                if text is None:
                    out.append(None)
                    continue
                parts, done = [], 0
                for kind, start, end in sorted(parser.spans(text), key=lambda s: (s[1], -s[2])):
                    if start >= done:
                        parts += [text[done:start], f"[{kind.upper()}]"]
                    done = max(done, end)
                out.append("".join([*parts, text[done:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(mask, schema)


def count_of(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def query_op1(spark, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    counts = [count_of(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return out.select("doc_id", *counts, "base_sha256", "spans")
