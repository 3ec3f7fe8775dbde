"""Operator 8: token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped for reading.

Format. A data set is a folder of numbered parts in ascending document order. ``part-N.bin`` holds ids of all its documents
one after another, unsigned little-endian, 2 bytes each where the vocabulary has at most 65,536 ids, else 4.
``part-N.idx`` holds, as 64-bit little-endian integers: the number n of documents, the bytes of one id, n document ids,
n + 1 offsets (in ids, from the part's start). The base of a part, the number of ids before it, is the prefix sum of the parts.

Documents are range-partitioned by doc_id, so parts hold disjoint, ascending ranges and no task sees more than its range.
Tasks write under a name of their own attempt and then rename, so a task that is run again leaves the same file.

Cases: a null or empty text holds the end id alone; rows with equal doc_id stay apart, in the order of their texts; a null
doc_id sorts first and is read back as null; very long texts are encoded in pieces cut at spaces; an empty table makes no
parts and an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm._shared import fresh_path, table

_NULL_ID = -(1 << 63)
_CODERS: dict[str, "WordCoder"] = {}


class WordCoder:
    """Encodes texts with a tokenizer whose pre-tokens never cross a space or line feed: words are encoded once each.

    The words that a batch of texts adds go to the tokenizer together; the table of known words is emptied when it holds
    ``most`` words, so its memory is bounded. A word of letters before one closing mark is encoded as the two pre-tokens it
    is, and plain ASCII letters in lower case as the tokenizer's normaliser makes them, so variants of a word share its ids."""

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lower_case = "Lowercase" in str(self.tokenizer.normalizer)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, self.kind).tobytes()

    def _stem(self, word: str) -> str | None:
        """The word of letters that ``word`` is a variant of; None if it is to be encoded as it stands."""
        core = word[:-1] if word and word[-1] in ",.;:!?" else word
        if not core.isalpha():
            return None
        if core.isascii():
            return core.lower() if self.lower_case else core
        # a letter that the normaliser turns into a letter and a mark of its own would draw the closing mark to it
        return core if unicodedata.normalize("NFC", core).lower().isalpha() else None

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        seen = {w for words in split for w in words}
        fresh = [w for w in seen if w not in self.known]  # looks up the batch's words; the known ones are not walked
        if len(self.known) + len(fresh) > self.most:
            self.known, fresh = {}, list(seen)
        known = self.known
        stems = {w: self._stem(w) for w in fresh}
        self._learn([w for w in {*(s or w for w, s in stems.items()), *",.;:!?"} if w not in known])
        for w, s in stems.items():
            if s is not None and w not in known:
                known[w] = known[s] + known[w[-1]] if len(w) > len(s) else known[s]
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def _store(path: str):
    """The file system and path of a shared folder; local folders are used directly, so that files can be mapped."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _put(path: str, name: str, parts: list[bytes]) -> None:
    store, at = _store(path)
    draft = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for p in parts:
            out.write(p)
    store.move(draft, f"{at}/{name}")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every text, append ``end_id``, write the data set to ``folder``; returns one record a part, bases included."""
    spark = docs.sparkSession
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = _coder(tokenizer_path)
        end = np.array([end_id], coder.kind).tobytes()
        store, at = _store(folder)
        name = f"part-{part:06d}"
        draft = f"{at}/.{name}.bin.{uuid.uuid4().hex}"
        ids: list[int] = []
        sizes: list[int] = []
        out = None
        for batch in batches:
            ids += [_NULL_ID if i is None else i for i in batch.column(0).to_pylist()]
            out = out or store.open_output_stream(draft)
            column = batch.column(1).to_pylist()
            for lo in range(0, len(column), 256):
                coded = coder.encode(column[lo : lo + 256])
                sizes += [len(c) // coder.kind.itemsize + 1 for c in coded]
                out.write(b"".join(x for c in coded for x in (c, end)))
        if out is None:
            return
        out.close()
        store.move(draft, f"{at}/{name}.bin")
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype("<i8")
        _put(folder, f"{name}.idx", [np.array([len(ids), coder.kind.itemsize], "<i8").tobytes(), np.array(ids, "<i8").tobytes(), offsets.tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], names=["part", "n_docs", "n_ids"])

    made = {r["part"]: r for r in ranged.mapInArrow(write, "part int, n_docs long, n_ids long").collect()}  # one row a part
    table_, base = [], 0
    for p in sorted(made):
        table_.append({"part": p, "n_docs": made[p]["n_docs"], "n_ids": made[p]["n_ids"], "base": base})
        base += made[p]["n_ids"]
    _put(folder, "parts.json", [json.dumps(table_).encode()])
    return table_


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before the document in the data set), n_tokens, ids_crc32, from the files alone."""
    store, at = _store(folder)
    with store.open_input_stream(f"{at}/parts.json") as f:
        parts = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(p["part"], p["base"]) for p in parts], "part int, base long").repartition(len(parts), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)

        def mapped(name: str) -> pa.Buffer:
            where = f"{at}/{name}"
            with pa.memory_map(where) if store.type_name == "local" else store.open_input_file(where) as f:
                return f.read_buffer()

        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = np.frombuffer(mapped(f"part-{part:06d}.idx"), "<i8")
                n, item = int(head[0]), int(head[1])
                ids, offsets = head[2 : 2 + n], head[2 + n :]
                tokens = np.frombuffer(mapped(f"part-{part:06d}.bin"), f"<u{item}")
                crc = np.fromiter((zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4")) for i in range(n)), np.int64, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == _NULL_ID), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(read, schema)


def query_op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, folder)
    return read_token_files(spark, folder)
