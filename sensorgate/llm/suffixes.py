"""Repeated passages by suffix order and longest previous factors.

A byte belongs to a repeat if a string of ``length`` bytes that covers it also starts anywhere else in the corpus. Windows
never cross documents. The work is cut so that no suffix order of the whole corpus is needed, and stays exact:

1. Every window of ``length`` bytes has an anchor: the leftmost of its 32-byte grams of least hash. Equal windows have
   equal anchors at equal places. Neighbouring windows mostly share the anchor; such a run and the bytes it spans (its
   context) is one row: about one row for 185 bytes of text.
2. Contexts are counted by (anchor, digest). A context that occurs twice is a repeat as a whole. One whose anchor occurs
   only once has no repeat. Only contexts whose anchor also occurs in a different context are open.
3. For the open ones the contexts of an anchor are brought together, one of each digest, and suffixes are sorted by
   prefix doubling as far as ``length`` bytes. Suffixes that agree so far keep the order of their positions, so the
   previous smaller position in suffix order is the left neighbour, the next smaller one does not match, and the longest
   previous factor reaches ``length`` where the left neighbour agrees. Looking at the right neighbour gives the same for
   later positions.
4. Anchors of very many different contexts (a frequent passage in as many surroundings) are not sorted in one task. Their
   contexts are cut, by the distance of windows to the anchor, in parts of 64, then 16, 4 and 1 windows. Parts that hold
   equal windows agree in the bytes that all windows of the part share, so these bytes make the key of a smaller group,
   which is treated like an anchor again: counted, sorted or cut further. Single windows are settled by counting.

``first`` keeps the first copy in the order of (doc_id, text hash, position) and removes later ones; otherwise all copies
count. Spans are judged on the input, not on what is left.

Defined cases: a null or empty text, or one shorter than ``length``, has no window; texts of any length are read whole;
rows that share id and text are separate documents for ``first=False`` and one place for ``first=True``, where both stay;
a null id is a value like any other; an empty table gives no row; other columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm.common import documents, in_slices, query, stored
from sensorgate.llm.words import slices

GRAM = 32
CROWD = 512  # different contexts of one anchor that are sorted together
BATCH = 500_000  # bytes of texts or contexts that a worker looks at together; its arrays take about 90 times as much
_PLACE = np.uint64((1 << 27) - 1)  # bits of a gram's key that hold its place
_SEGMENT = 1 << 22


def _table() -> np.ndarray:
    return np.random.default_rng(64).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    h, width = table[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + h[width:]
        width *= 2
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def runs(data: np.ndarray, ends: np.ndarray, length: int, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window start, number of windows, distance from the start to the anchor and anchor hash of each run.

    ``ends``: where documents end in ``data``.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(data, table)
    least, width, span = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64), 1, length - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    start = np.arange(len(least))
    end = ends[np.searchsorted(ends, start, "right")]
    inside = start + length <= end
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (end[1:] != end[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(least)))
    first, count = first[inside[first]], count[inside[first]]
    place = (least[first] & _PLACE).astype(np.int64)
    return first, count, place - first, hashes[place]


RUNS = "doc_id long, tie long, anchor long, start long, windows int, lead int, digest long"


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """The runs of all texts. ``docs`` has ``doc_id, tie, text``."""
    schema = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in RUNS.split(", ")])

    def parts(texts: list[str]) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
        """Pieces to look at together: index of the text, bytes, place in the text. A huge text comes in overlapping segments."""
        for a, b in slices(texts, BATCH):
            coded = [t.encode() for t in texts[a:b]]
            if b - a == 1 and len(coded[0]) > _SEGMENT:
                for at in range(0, len(coded[0]) - length + 1, _SEGMENT):
                    yield [a], [coded[0][at : at + _SEGMENT + length - 1]], [at]
            else:
                yield list(range(a, b)), coded, [0] * (b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in in_slices(batches):
            for which, coded, place in parts(batch.column(2).to_pylist()):
                data, ends = b"".join(coded), np.cumsum([len(c) for c in coded])
                first, count, lead, anchor = runs(np.frombuffer(data, np.uint8), ends, length, table)
                if not len(first):
                    continue
                own = np.searchsorted(ends, first, "right")
                begins = np.concatenate([[0], ends[:-1]])
                start = first - begins[own] + np.array(place)[own]
                # Unsigned digests wrap to signed longs.
                digest = np.array([xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)], np.uint64)
                rows = pa.array(np.array(which)[own])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor.view(np.int64)), pa.array(start), pa.array(count.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(digest.view(np.int64))], schema=schema)

    return docs.select("doc_id", "tie", "text").mapInArrow(run, RUNS)


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each place in suffix order (equal ranks: equal bytes); places too near the end are left out."""
    if length < 8:
        width, key = 1, data.astype(np.int64)
    else:
        words = np.lib.stride_tricks.sliding_window_view(data, 8)
        width, key = 8, np.ascontiguousarray(words).view(">u8").reshape(-1)
    rank = np.unique(key, return_inverse=True)[1].reshape(-1).astype(np.int64)
    while width < length:
        step = min(width, length - width)
        key = rank[:-step] * len(data) + rank[step:]
        rank = np.unique(key, return_inverse=True)[1].reshape(-1).astype(np.int64)
        width += step
    return rank


def matches(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal string starts before, and after, each of the places (given in ascending order of position)."""
    order = np.argsort(rank, kind="stable")  # the suffix order; equal strings by position
    agree = rank[order][1:] == rank[order][:-1]
    before, after = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    before[order[1:]] = agree
    after[order[:-1]] = agree
    return before, after


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal spans of the bytes that windows of ascending starts cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist(), strict=True))


SPANS = "doc_id long, tie long, start long, stop long"


def compared(contexts: DataFrame, length: int, first: bool) -> DataFrame:
    """Repeats among the contexts of each anchor: ``doc_id, tie, start, stop``."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "tie", "start", "stop")])

    def judge(group: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(g[5] for g in group), np.uint8)
        rank = ranks(data, length)
        bases = np.cumsum([0, *(len(g[5]) for g in group)])
        place = np.concatenate([np.arange(b, b + len(g[5]) - length + 1) for g, b in zip(group, bases, strict=False)])
        before, after = matches(rank[place])
        hit, rows = before if first else before | after, []
        counts = np.cumsum([0, *(len(g[5]) - length + 1 for g in group)])
        for g, a, b in zip(group, counts, counts[1:], strict=False):
            rows += [(g[1], g[2], g[3] + s, g[3] + e) for s, e in covered(np.flatnonzero(hit[a:b]), length)]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in in_slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH and row[0] != group[-1][0]:
                    yield judge(group)
                    group, size = [], 0
                group.append(row)
                size += len(row[5])
        if group:
            yield judge(group)

    ordered = contexts.select("anchor", "doc_id", "tie", "start", "windows", "context").repartition("anchor")
    return ordered.sortWithinPartitions("anchor", "doc_id", "tie", "start").mapInArrow(run, SPANS)


CONTEXTS = "anchor long, m long, doc_id long, tie long, start long, windows int, lead int, context binary"
PARTS = "anchor long, doc_id long, tie long, start long, windows int, lead int, context binary, digest long"
PLACE = ("doc_id", "tie", "start", "windows", "lead")


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in text.split(", ")])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cut_by_distance(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """Parts of the contexts: windows whose distance to the anchor lies in one cell of ``width``, with the key of the bytes
    that all windows of the cell share."""
    schema = _schema(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = []
            for anchor, doc, tie, start, windows, lead, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 0  # windows come with falling distance lead, lead - 1, ...
                while at < windows:
                    cell = (lead - at) // width
                    n = min(windows - at, lead - at - cell * width + 1)
                    core = context[lead - cell * width : lead - (cell + 1) * width + 1 + length]
                    part = context[at : at + n + length - 1]
                    key = _signed(xxhash.xxh3_64_intdigest(core, seed=(anchor ^ cell * 64 + width) & (1 << 64) - 1))
                    rows.append((key, doc, tie, start + at, n, lead - at, part, _signed(xxhash.xxh3_64_intdigest(part))))
                    at += n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return contexts.select("anchor", *PLACE, "context").mapInArrow(run, PARTS)


def settled(found: DataFrame, length: int, first: bool) -> tuple[DataFrame, DataFrame]:
    """Counting step for rows of ``anchor, digest`` and a place: spans of contexts that occur twice, and the place of the
    first copy of each context whose anchor has several (``anchor, m`` and the place)."""
    place = F.struct(*PLACE)
    contexts = stored(found.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(place).alias("least")), "contexts")
    shared = contexts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    open_ = contexts.join(shared, "anchor").select("anchor", "digest", "m", "least.*")
    whole = found.select("anchor", "digest", *PLACE).join(contexts.where("n > 1").select("anchor", "digest", "least"), ["anchor", "digest"])
    if first:
        whole = whole.where(~place.eqNullSafe(F.col("least")))
    return whole.select("doc_id", "tie", "start", (F.col("start") + F.col("windows") + length - 1).alias("stop")), open_


def crowded(contexts: DataFrame, length: int, first: bool) -> list[DataFrame]:
    """Spans of repeats among contexts of anchors that have more than CROWD of them."""
    spans, width = [], 64
    while not contexts.isEmpty():
        parts = stored(cut_by_distance(contexts, length, width), "parts")
        whole, open_ = settled(parts, length, first)
        spans.append(whole)
        if width == 1:
            break
        same = parts.doc_id.eqNullSafe(F.col("_doc")) & (parts.tie == F.col("_tie")) & (parts.start == F.col("_start")) & (parts.anchor == F.col("_anchor"))
        wanted = open_.select(F.col("anchor").alias("_anchor"), "m", F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), F.col("start").alias("_start"))
        texts = stored(parts.join(wanted, same).select("anchor", "m", *PLACE, "context"), "open_parts")
        spans.append(compared(texts.where(F.col("m") <= CROWD), length, first))
        contexts, width = texts.where(F.col("m") > CROWD), width // 4
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))


def same_row(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (doc_id, tie), a null id being equal to itself; columns of ``a`` and the others of ``b``."""
    b = b.withColumnsRenamed({"doc_id": "_doc", "tie": "_tie"})
    return a.join(b, a.doc_id.eqNullSafe(b._doc) & (a.tie == b._tie), how).drop("_doc", "_tie")


def repeats(docs: DataFrame, length: int = 400, first: bool = False) -> DataFrame:
    """``doc_id, tie, spans``: sorted, possibly overlapping byte spans to remove, for rows that have any.

    ``docs`` is a frame made by ``keyed``.
    """
    if length < 2 * GRAM:
        raise ValueError(f"repeats of at least {2 * GRAM} bytes are found")
    found = stored(anchored(docs, length), "runs")
    whole, open_ = settled(found, length, first)
    wanted = open_.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "m", "start", "windows", "lead")).alias("wanted"))
    schema = _schema(CONTEXTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for doc, tie, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text", "wanted")), strict=True):
                data = text.encode()
                rows = [(w["anchor"], w["m"], doc, tie, w["start"], w["windows"], w["lead"], data[w["start"] : w["start"] + w["windows"] + length - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    texts = stored(same_row(docs, wanted).mapInArrow(cut, CONTEXTS), "open_contexts")
    spans = whole.union(compared(texts.where(F.col("m") <= CROWD), length, first))
    for more in crowded(texts.where(F.col("m") > CROWD), length, first):
        spans = spans.union(more)
    return spans.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in () if spans is None else spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no UTF-8 character is cut."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, first: bool = True) -> DataFrame:
    """``docs``, all columns, with repeats cut out of the texts (whole characters); rows stay even where nothing is left."""
    keys = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    keys = keys.withColumn("_hash", F.xxhash64("_text"))
    spans = repeats(keyed(docs), length, first).withColumnsRenamed({"doc_id": "_doc", "tie": "_tie", "spans": "_spans"})
    joined = keys.join(stored(spans, "spans"), keys.doc_id.eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_tie")), "left")

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        out = []
        for t, s in zip(text, spans, strict=True):
            data = t.encode()
            out.append(kept_bytes(data, whole_characters(data, merged(s))).decode())
        return pd.Series(out, dtype=object)

    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut("_text", F.coalesce("_spans", F.expr("array()"))))).select(docs.columns)


@query("op8_suffixes")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(documents(spark, folder))
    found = same_row(docs, stored(repeats(docs, 400), "spans"), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    arrow = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in schema.split(", ")])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data, own = text.encode(), merged(spans)
                rows.append((doc, len(data), sum(b - a for a, b in own), len(own), hashlib.sha256(kept_bytes(data, own)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return found.select("doc_id", "text", "spans").mapInArrow(digest, schema)
