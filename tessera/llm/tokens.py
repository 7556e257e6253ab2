"""Operator 6: token ids as compressed binary, with short access to each document.

A file is a table of blocks in ascending doc_id order. A block holds one
zstandard frame for each document, all made with one dictionary that was
trained on serialized id arrays; the offsets of the frames; the ids and token
counts of the documents, and the least and the largest id; how many ids of its
part lie before it; and the SHA-256 of the dictionary, which lies beside the
blocks. A document is read from the blocks whose bounds hold its id, and of
these by its frame alone.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded, partitions, table, values_of

END = 2
#: The dictionary: its bytes, and the documents (of at most so many characters) that it is trained on.
DICTIONARY_BYTES, FIT_DOCUMENTS, FIT_CHARACTERS = 64 * 1024, 1_000, 20_000
LEVEL = 3
#: A block ends after so many documents or bytes of frames.
BLOCK_DOCUMENTS, BLOCK_BYTES = 4096, 4 << 20
#: Pieces of text whose ids a task keeps; documents that it encodes together.
CACHE, TOGETHER = 300_000, 256
_AFTER_LETTER = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)")

BLOCKS = "part int, block int, min_id bigint, max_id bigint, dictionary string, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, before bigint, payload binary"


class _Rows(dict):
    """piece -> row; a piece that is looked up for the first time gets the next row and is noted as new."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        row = self[piece] = len(self)
        self.new.append(piece)
        return row


@lru_cache(1)
def tokenizer_of(path: str):  # noqa: ANN201
    """The tokenizer of a Python worker, read once; what a task learns goes with the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space, and parts letters from punctuation.

    The ids of a text are then those of its pieces between ASCII white space,
    and before ASCII punctuation that follows a letter, one after another. New
    pieces are encoded together, apart by a special token of the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        added = {i: str(t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.apart = max(added.items())
        # Where tokens show that they end a word, a run of letters has one such token, its last.
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max([*words.values(), *added]), bool)
        self.ends[[i for t, i in words.items() if t.endswith("</w>")]] = True
        self.special = tuple(t.encode("utf-8") for t in added.values())
        self._clear()

    def _clear(self) -> None:
        self.rows = _Rows()
        self.start, self.count, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _add(self, rows: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.start[rows], self.count[rows] = self.used + np.cumsum(count) - count, count
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        """Encodes the pieces that were looked up but are new."""
        new, self.rows.new = self.rows.new, []
        while len(self.rows) > len(self.start):
            self.start, self.count = np.concatenate([self.start, self.start]), np.concatenate([self.count, self.count])
        known = len(self.rows) - len(new)
        words = [(known + i, w.decode("utf-8")) for i, w in enumerate(new)]
        left = words
        if self.ends.any():
            letters, left = [x for x in words if x[1].isalpha()], [x for x in words if not x[1].isalpha()]
            for i in range(0, len(letters), 4096):
                part = letters[i : i + 4096]
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(t for _, t in part)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.ends[ids])
                if len(ends) == len(part) and ends[-1] == len(ids) - 1:
                    self._add(np.array([r for r, _ in part]), np.diff(ends, prepend=-1), ids)
                else:
                    left += part
        for i in range(0, len(left), 4096):
            part = left[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.apart} ".join(t for _, t in part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            self._add(np.array([r for r, _ in part]), np.diff(ends, prepend=-1) - 1, ids[ids != self.mark])

    def _pieces(self, text: str) -> list[bytes] | np.ndarray:
        """The pieces of a text; its ids, if it spells out a special token."""
        data = text.encode("utf-8")
        if any(t in data for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return _AFTER_LETTER.sub(rb" \g<0>", data.lower()).split()

    def encode_all(self, texts: list[str | None], end: int = END) -> list[np.ndarray]:
        """For each text all its ids, then `end`; a null text is empty."""
        out = []
        for i in range(0, len(texts), TOGETHER):
            if len(self.rows) > CACHE:
                self._clear()
            found = [self._pieces(t or "") for t in texts[i : i + TOGETHER]]
            found = [np.fromiter(map(self.rows.__getitem__, p), np.int64, len(p)) if isinstance(p, list) else p for p in found]
            self._learn()
            for row in found:
                if row.dtype != np.int64:
                    out.append(np.append(row, np.array([end], "<u4")))
                    continue
                count = self.count[row]
                ids = np.full(int(count.sum()) + 1, end, "<u4")
                ids[:-1] = self.pool[np.arange(len(ids) - 1) + np.repeat(self.start[row] - (np.cumsum(count) - count), count)]
                out.append(ids)
        return out


def serialize(ids: np.ndarray) -> bytes:
    """A byte for the width, then little-endian ids, of two bytes where all fit."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def deserialize(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """From a bounded sample; of few documents, their ids themselves; of none, empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(serialize, encoder.encode_all(list(values_of(b.column(0)))))), pa.binary())], ["ids"])

    short = docs.where((F.length("text") > 0) & (F.length("text") <= FIT_CHARACTERS))
    ids = bounded(short.select("doc_id"), FIT_DOCUMENTS, "doc_id").distinct()
    sample = short.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", "text")).limit(2 * FIT_DOCUMENTS).select("text")
    found = sorted(bytes(r.ids) for r in sample.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """docs (doc_id, text) -> a file at `path`. Null ids come first; a null text is empty; equal ids stay apart, in the order of a hash of their texts.

    Texts are dealt to parts by ranges of id and hash, so that no id fills a
    part alone, and are encoded where their blocks are packed. No row is lost
    or merged; other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    data = train_dictionary(docs, tokenizer)
    name = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(name, bytearray(data))], "dictionary string, bytes binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(data)
    long = pa.list_(pa.int64())
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), long, long, long, pa.int64(), pa.binary()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = WordEncoder(tokenizer), zstandard.ZstdCompressor(LEVEL, dict_data=_dictionary(shared.value))
        ids: list = []
        counts: list[int] = []
        offsets, payload = [0], bytearray()
        part, block, before = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, offsets, payload, block, before
            known = [i for i in ids if i is not None]
            columns = [part], [block], [min(known, default=None)], [max(known, default=None)], [name], [ids], [counts], [offsets], [before], [bytes(payload)]
            block, before = block + 1, before + sum(counts)
            ids, counts, offsets, payload = [], [], [0], bytearray()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "block", "min_id", "max_id", "dictionary", "doc_ids", "n_tokens", "offsets", "before", "payload"])

        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                own = b.slice(i, TOGETHER)
                part = own.column(2)[0].as_py() if own.num_rows else part
                for key, found in zip(own.column(0).to_pylist(), encoder.encode_all(own.column(1).to_pylist()), strict=True):
                    frame = press.compress(serialize(found))
                    if ids and (len(ids) >= BLOCK_DOCUMENTS or len(payload) + len(frame) > BLOCK_BYTES):
                        yield flush()
                    ids.append(key)
                    counts.append(len(found))
                    payload += frame
                    offsets.append(len(payload))
        if ids:
            yield flush()

    key, tie = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = docs.repartitionByRange(partitions(spark), key, tie).sortWithinPartitions(key, tie).withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(pack, BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, dictionary, from the file alone.

    Raises where a block names another dictionary than the one that lies beside it.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    stored = spark.read.parquet(f"{path}/dictionary").first()
    name, shared = stored.dictionary, spark.sparkContext.broadcast(bytes(stored.bytes))
    if hashlib.sha256(shared.value).hexdigest() != name:
        raise ValueError("the dictionary is not the one that was written")
    # One row for each part, and parts are as many as shuffle partitions.
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("ids"))
    before = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for b in batches:
            for k in range(b.num_rows):  # one block at a time as Python objects
                row = b.slice(k, 1).to_pylist()[0]
                if row["dictionary"] != name:
                    raise ValueError("a block names another dictionary")
                view, o = memoryview(row["payload"]), row["offsets"]
                ids = [deserialize(press.decompress(view[x:y])) for x, y in zip(o, o[1:], strict=False)]
                counts = [len(x) for x in ids]
                start = row["part_start"] + row["before"] + np.cumsum([0, *counts])[:-1]
                columns = row["doc_ids"], start.tolist(), counts, [zlib.crc32(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([name] * len(ids), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "dictionary"])

    return blocks.join(F.broadcast(before), "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, dictionary string")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with that id: only the blocks that hold it are read, and of these only its frames are opened."""
    stored = spark.read.parquet(f"{path}/dictionary").first()
    press = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(stored.bytes)))
    at = F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.col("doc_ids")[i] == doc_id)
    hit = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id)).withColumn("i", F.explode(at))
    o = F.col("offsets")
    frames = hit.select("part", "block", "i", F.substring("payload", o[F.col("i")].cast("int") + 1, (o[F.col("i") + 1] - o[F.col("i")]).cast("int")).alias("frame")).orderBy("part", "block", "i")
    return [deserialize(press.decompress(bytes(r.frame))) for r in frames.collect()]


def tokenize(docs: DataFrame, tokenizer: str, scratch: Scratch | None = None) -> DataFrame:
    """Writes docs (doc_id, text) to a file in the shared folder and reads it back."""
    scratch = scratch or Scratch(docs.sparkSession)
    write_tokens(docs, scratch.path("tokens"), tokenizer)
    return read_tokens(docs.sparkSession, scratch.path("tokens"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token file of every whole text of `documents`, read back."""
    import public_tokenizers

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
