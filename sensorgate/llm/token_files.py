"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

A shard is one file: ``HEADER`` (magic, bytes per id), then the raw ids of its documents without gaps, in ascending
``doc_id`` order over all shards. The index is a set of files, one per hash bucket of keys: a cascade of bit arrays
sends every key to its own slot (minimal: as many slots as keys), and the slot holds a 32-bit fingerprint, the shard,
the offset and the length in ids. A lookup costs a few bit tests and reads one slot, whatever the corpus size; a key
that was never stored is turned away by its fingerprint (but for one in 2**32).

Files are named after the task attempt that wrote them, and only the attempts whose rows Spark commits are ever read,
so lost executors and repeated attempts leave no wrong data. Files go to the folder in ``spark.checkpoint.dir``.

Defined cases: a null text is an empty one (it still has its end id); a null key sorts first; rows that share a key are
all stored and numbered (``copy``) in the order of the hash of their texts; an empty table gives no shard; other columns
are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm.common import WORD_VOCAB, crc32, documents, query, stored
from sensorgate.llm.words import encoder, slices
from sensorgate.session import scratch_path

HEADER = "<8sQ"
START = struct.calcsize(HEADER)
MAGIC = b"TOKENIDS"
ENTRY = "doc_id long, copy long, shard int, file string, offset long, n_tokens long"
ENTRY_ARROW = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("shard", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])
KEYS_PER_INDEX = 50_000


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, vocabulary: str, end: int | None, folder: str) -> DataFrame:
    """Encode ``doc_id, text`` and write one shard per range of ids; returns an entry per row of ``docs``."""
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), encoder(vocabulary)
        last = b"" if end is None else np.array([end], encode.width).tobytes()
        width, shard, offset, previous, copy, started, out = np.dtype(encode.width).itemsize, context.partitionId(), 0, None, 0, False, None
        name = f"shard-{shard:06d}-{context.taskAttemptId()}.bin"
        where, path = filesystem(folder)
        where.create_dir(path, recursive=True)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if out is None:
                out = where.open_output_stream(f"{path}/{name}")
                out.write(struct.pack(HEADER, MAGIC, width))
            for a, b in slices(texts):
                rows = []
                for key, ids in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    copy = copy + 1 if started and key == previous else 0
                    started, previous = True, key
                    out.write(ids)
                    out.write(last)
                    n = (len(ids) + len(last)) // width
                    rows.append((key, copy, shard, name, offset, n))
                    offset += n
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "copy", "shard", "file", "offset", "n_tokens"), r, strict=True)) for r in rows], ENTRY_ARROW)
        if out:
            out.close()

    return ordered.select("doc_id", "text").mapInArrow(write, ENTRY)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: level after level, keys alone on a bit keep it, the rest go on."""

    LOAD = 1.5  # bits per key and level
    LEVELS = 80

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        base = np.cumsum([0, *(c[-1] for c in counts)])
        self.rank = [c[:-1] + b for c, b in zip(counts, base, strict=False)]

    @staticmethod
    def spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (keys ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return ((x ^ x >> np.uint64(29)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            if len(levels) == cls.LEVELS:
                raise ValueError("two keys have the same 64-bit hash")
            at = cls.spot(keys, len(levels), max(1, int(len(keys) * cls.LOAD)))
            alone = np.bincount(at, minlength=max(1, int(len(keys) * cls.LOAD))) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level takes it."""
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            at = self.spot(keys[left], i, len(level))
            hit = level[at]
            slot[left[hit]] = self.rank[i][at[hit]]
            left = left[~hit]
        return slot

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u8").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        n = int(np.frombuffer(data, "<u8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u8", n, 8).astype(int), 8 * (n + 1), []
        for size in sizes:
            bits = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(bits, count=size).astype(bool))
            at += len(bits)
        return cls(levels), at


def _key(doc_id: str = "doc_id", copy: str = "copy"):
    """Hash of a key; nulls differ from every number because Spark skips them."""
    return F.xxhash64(F.col(doc_id), F.col(copy), F.col(doc_id).isNull())


def build_index(entries: DataFrame, folder: str) -> DataFrame:
    """Write the index files of entries; returns ``bucket, index_file``, one row per file."""
    buckets = max(1, -(-entries.count() // KEYS_PER_INDEX))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
        mph = PerfectHash.build(keys)
        slots = np.zeros(len(keys), SLOT)
        at = mph(keys)
        for field, column in (("print", keys >> np.uint64(32)), ("shard", pdf["shard"]), ("offset", pdf["offset"]), ("n", pdf["n_tokens"])):
            slots[field][at] = column
        name = f"index-{pdf['bucket'].iloc[0]:06d}-{TaskContext.get().taskAttemptId()}.bin"
        where, path = filesystem(folder)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/{name}") as out:
            out.write(mph.to_bytes() + slots.tobytes())
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "buckets": [buckets], "index_file": [name]})

    keyed = entries.select(_key().alias("key"), "shard", "offset", "n_tokens").withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return stored(keyed.groupBy("bucket").applyInPandas(write, "bucket long, buckets long, index_file string"), "index_files")


def lookup(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, copy, shard, offset, n_tokens`` of those keys that the index holds."""
    buckets = index.agg(F.max("buckets")).first()[0]

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        where, path = filesystem(folder)
        with where.open_input_file(f"{path}/{pdf['index_file'].iloc[0]}") as f:
            data = f.read()
        mph, at = PerfectHash.from_bytes(data)
        slots, hashed = np.frombuffer(data, SLOT, offset=at), pdf["key"].to_numpy(np.int64).view(np.uint64)
        slot = mph(hashed)
        held = (slot >= 0) & (slots["print"][slot] == (hashed >> np.uint64(32)).astype("<u4"))
        got, out = slots[slot[held]], pdf.loc[held, ["doc_id", "copy"]]
        return out.assign(shard=got["shard"].astype(np.int32), offset=got["offset"].astype(np.int64), n_tokens=got["n"].astype(np.int64))

    keyed = keys.select("doc_id", "copy", _key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets or 1)))
    joined = keyed.join(index.select("bucket", "index_file"), "bucket")
    return joined.groupBy("bucket").applyInPandas(find, "doc_id long, copy long, shard int, offset long, n_tokens long")


def read_shards(found: DataFrame, shards: DataFrame, folder: str, make, schema: str) -> DataFrame:
    """``make(rows, ids)`` over the found documents of each shard, read in file order.

    rows is a pandas frame sorted by offset; ids gives the ids of a row as an array. ``shards`` has ``shard, file, base``.
    """

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset", kind="stable", ignore_index=True)
        where, path = filesystem(folder)
        with where.open_input_file(f"{path}/{pdf['file'].iloc[0]}") as f:
            magic, width = struct.unpack(HEADER, f.read(START))
            if magic != MAGIC:
                raise ValueError("not a shard")

            def ids(row) -> np.ndarray:
                return np.frombuffer(f.read_at(int(row.n_tokens) * width, START + int(row.offset) * width), f"<u{width}")

            return make(pdf, ids)

    return found.join(shards, "shard").groupBy("shard").applyInPandas(read, schema)


def shard_bases(entries: DataFrame) -> DataFrame:
    """``shard, file, base``: ids in all shards before; as many rows as shards, summed on the driver."""
    rows = entries.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    base = np.cumsum([0, *(r.n for r in rows)]).tolist()
    data = [(r.shard, r.file, b) for r, b in zip(rows, base, strict=False)]
    return entries.sparkSession.createDataFrame(data, "shard int, file string, base long")


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_path(spark, "token_files")
    entries = stored(write_shards(documents(spark, folder), WORD_VOCAB, 2, place), "entries")
    found = lookup(entries.select("doc_id", "copy"), build_index(entries, place), place)

    def digest(pdf, ids):
        sums = [crc32(ids(r)) for r in pdf.itertuples()]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "start": pdf["base"] + pdf["offset"], "n_tokens": pdf["n_tokens"], "ids_crc32": sums})

    return read_shards(found, shard_bases(entries), place, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
