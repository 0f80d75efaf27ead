"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the set of its shingles of five lower-case words, each with a weight: 1 + ln(count in the text), times an idf
factor between 1 and 1.25. Document frequencies come from a count sketch over all documents; the idf falls linearly in
the logarithm of the share of documents from 1.25 (a share of 1/1024 or less) to 1 (all documents). The factor is narrow
on purpose: shingles of a large group of copies are frequent because of the group, and a steep idf would make the few
edited shingles of its members outweigh them. The sketch knows shares to about (shingles per document) / 2**20, at any
size of the corpus.

Consistent weighted sampling draws, for each of 100 positions, one shingle and one step of its weight so that two texts
agree with the probability of their weighted Jaccard similarity. Twenty bands of five positions make candidates (two
texts of similarity 0.8 meet with probability 0.9996), and candidates are verified by the exact weighted Jaccard of
their whole texts. Classes are the connected components of verified pairs.

Exact copies (equal word sequences) are joined first by a 128-bit digest, so a group of copies is one text afterwards.
A band key of at most 16 texts gives all its pairs. In a key of more, all are compared with the most central of them (the
one in the most and largest of such keys). Then every pair of texts of the key that are still in different components is a
candidate: blocks of texts outside the largest component meet each other and the blocks of that component, and signatures
are compared there before any text is read. A first pass verifies a spanning forest of the likely pairs of each task. In
the second one the texts that still have likely partners across send their weighted shingles to the tasks, each pair is
compared exactly at one of its keys, and a task returns a spanning forest of the links that hold: a key gives fewer rows
than it has texts, also where all are likely and none alike. Pairs whose signatures agree in fewer than 60 of 100
positions are not verified.

Defined cases: a null or empty text is in a class of its own; a text of fewer than five words is one shingle; rows that
share an id are one document, with the links of all its texts, but ``without_copies`` takes each of its texts for itself;
a null id has class null; an empty table gives no row; other columns are ignored here and kept by ``without_copies``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm.common import documents, freeing, query, stored
from sensorgate.llm.components import components

SHINGLE = 5
POSITIONS, BANDS = 100, 20
THRESHOLD = 0.8
LIKELY = 60  # agreeing positions below which a pair is not verified
SMALL = 16  # texts of a key of which all pairs are candidates
BLOCK = 2048  # texts of a larger key on each side of a comparison of signatures, about
SHINGLES = 1_000_000  # of the texts on each side of a comparison of shingles, about (16 MB)
COUNTERS = 1 << 20
BLOCKS = 16  # of counters
IDF_SHARE, IDF_FLOOR = 0.25, 1 / 1024
VARIATES = 1 << 14


class Shingler:
    """Distinct shingle hashes of a text in ascending order, and their counts."""

    def __init__(self, size: int = SHINGLE, most: int = 400_000):
        self.size, self.most, self.known = size, most, {}
        self.factors = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(size)], np.uint64)

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        missing = set(words).difference(known)
        if len(known) + len(missing) > self.most:
            known.clear()
            missing = set(words)
        known.update((w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in missing)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        for w in missing:
            if len(w) > 64:  # long words are not kept: the bound is a number of words
                del known[w]
        return out

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h = self.hashes(words)
        n = max(1, len(h) - self.size + 1) if len(h) else 0
        if len(h) < self.size:
            x = np.array([(h * self.factors[: len(h)]).sum()], np.uint64)[:n]
        else:
            x = sum(h[k : k + n] * self.factors[k] for k in range(self.size))
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(x ^ x >> np.uint64(32), return_counts=True)


@lru_cache(maxsize=1)
def shingler() -> Shingler:
    """One for a task."""
    return Shingler()


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def surveyed(docs: DataFrame) -> DataFrame:
    """One pass: ``doc_id, high, low, n`` (digest of the words) per row, and the counters of each task as ``block, counts``."""
    schema = pa.schema([("doc_id", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    @freeing(shingler)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, counters = shingler(), np.zeros(COUNTERS, np.uint32)
        part = TaskContext.get().partitionId() % 64
        for batch in batches:
            keys, rows, found = batch.column(0).to_pylist(), [], []
            for key, text in zip(keys, batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                found.append((make(words)[0] & np.uint64(COUNTERS - 1)).astype(np.int32))
                digest = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                rows.append((key, *np.frombuffer(digest, "<i8").tolist(), len(words), None, None, None))
                if len(found) == 256:
                    counters += np.bincount(np.concatenate(found), minlength=COUNTERS).astype(np.uint32)
                    found = []
            if found:
                counters += np.bincount(np.concatenate(found), minlength=COUNTERS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if counters.any():
            size = COUNTERS // BLOCKS
            rows = [(None, None, None, None, k, part, zlib.compress(counters[k * size : (k + 1) * size].tobytes(), 1)) for k in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, high long, low long, n long, block int, part int, counts binary")


def idf_factors(survey: DataFrame) -> np.ndarray:
    """Factor per counter; the sums of all tasks' counters, in two steps, are a table of fixed size."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // BLOCKS, np.uint64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        out = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [0], "counts": [zlib.compress(out, 1)]})

    kind = "block int, part int, counts binary"
    parts = survey.where("block IS NOT NULL").select("block", "part", "counts")
    sums = parts.groupBy("block", "part").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind).collect()
    counts = np.zeros(COUNTERS)
    for row in sums:
        counts[row.block * (COUNTERS // BLOCKS) : (row.block + 1) * (COUNTERS // BLOCKS)] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    documents_ = max(1, survey.where("block IS NULL").count())
    share = np.maximum(counts - counts.mean(), 1) / documents_
    rarity = np.log(np.clip(share, IDF_FLOOR, 1)) / np.log(IDF_FLOOR)
    return (1 + IDF_SHARE * rarity).astype(np.float32)


def weights(shingles: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts.astype(np.float32))) * idf[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two ascending arrays of shingles with their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum(dtype=float)
    high = a[1].sum(dtype=float) + b[1].sum(dtype=float) - low
    return low / high if high else 0.0


class Sampler:
    """Improved consistent weighted sampling with tabulated variates.

    With r, c from Gamma(2, 1) and b uniform, a weight s has the step t = floor(ln s / r + b) and the value
    ln c - r (t - b) - r; the shingle of least value is drawn, together with its step.
    """

    def __init__(self):
        rng = np.random.default_rng(20240501)
        r = rng.gamma(2, 1, (VARIATES, POSITIONS))
        c, b = rng.gamma(2, 1, r.shape), rng.random(r.shape)
        self.inverse, self.b, self.r, self.base = (x.astype(np.float32) for x in (1 / r, b, r, np.log(c) - r + r * b))

    def __call__(self, shingles: np.ndarray, weight: np.ndarray) -> np.ndarray:
        best = np.full(POSITIONS, np.inf, np.float32)
        drawn = np.zeros(POSITIONS, np.uint64)
        log, columns = np.log(weight).astype(np.float32), np.arange(POSITIONS)
        for at in range(0, len(shingles), 4096):
            own = shingles[at : at + 4096]
            row = (own >> np.uint64(40)).astype(np.int64) & (VARIATES - 1)
            t = np.floor(log[at : at + 4096, None] * self.inverse[row] + self.b[row])
            value = self.base[row] - self.r[row] * t
            first = value.argmin(0)
            least = value[first, columns]
            better = least < best
            best[better] = least[better]
            step = t[first, columns].astype(np.int64).astype(np.uint64)
            drawn[better] = (own[first] ^ step * np.uint64(0xC2B2AE3D27D4EB4F))[better]
        return drawn


@lru_cache(maxsize=1)
def sampler() -> Sampler:
    return Sampler()


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``doc_id, keys`` (one per band) and ``signature`` (a byte per position); texts without words have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("signature", pa.binary())])
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    @freeing(shingler)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, sample, idf = shingler(), sampler(), sent.value
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        factors = np.array([pow(0xE7037ED1A0B428DB, k + 1, 1 << 64) for k in range(POSITIONS // BANDS)], np.uint64)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is None or not (words := words_of(text)):
                    continue
                shingles, counts = make(words)
                drawn = sample(shingles, weights(shingles, counts, idf))
                mixed = (drawn ^ drawn >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                keys = (mixed.reshape(BANDS, -1) * factors).sum(1, dtype=np.uint64) ^ salt
                keys = (keys ^ keys >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
                rows.append((key, keys.view(np.int64), (mixed >> np.uint64(56)).astype(np.uint8).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<long>, signature binary")


def counted(members: DataFrame) -> DataFrame:
    """``key, id, n``: members of keys that at least two texts share."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(sizes, "key")


def all_pairs(members: DataFrame) -> DataFrame:
    """Pairs within keys of a bounded number of texts."""
    other = members.select("key", F.col("id").alias("b"))
    return members.select("key", F.col("id").alias("a")).join(other, "key").where("a < b").select("a", "b").distinct()


def likely(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in enough positions."""
    side = lambda name: signs.select(F.col("id").alias(name), F.col("signature").alias(f"s{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sa", "sb"))
                keep = pa.array((x == y).sum(1) >= LIKELY)
                yield batch.select(["a", "b"]).filter(keep)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Pairs of whole texts with at least the weighted Jaccard similarity."""
    side = lambda name: docs.select(F.col("doc_id").alias(name), F.col("text").alias(f"t{name}"))
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    @freeing(shingler)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, idf, last = shingler(), sent.value, [None, None]

        def weighted(text):
            shingles, counts = make(words_of(text))
            return shingles, weights(shingles, counts, idf)

        for batch in batches:
            keep, similarity = [], []
            for i in range(batch.num_rows):
                x, y = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if last[0] != y:
                    last = [y, weighted(y)]
                value = weighted_jaccard(weighted(x), last[1])
                if value >= threshold:
                    keep.append(i)
                    similarity.append(value)
            yield pa.RecordBatch.from_arrays([*batch.select(["a", "b"]).take(pa.array(keep, pa.int64())).columns, pa.array(similarity, pa.float64())], names=["a", "b", "similarity"])

    texts = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return texts.mapInArrow(run, "a long, b long, similarity double")


def forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the edges x-y of a maximum spanning forest."""
    order = np.argsort(-weight.astype(int), kind="stable")
    names, ends = np.unique(np.concatenate([x[order], y[order]]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    at, place, chosen = np.arange(len(names)), np.arange(len(order)), []
    while len(place):
        a, b = at[u[place]], at[v[place]]
        place, a, b = place[a != b], a[a != b], b[a != b]
        # The heaviest edge of each tree joins it to another one; of two trees that chose the same edge the first is the root.
        best, to = np.full(len(names), len(order)), np.arange(len(names))
        np.minimum.at(best, a, place)
        np.minimum.at(best, b, place)
        trees = np.flatnonzero(best < len(order))
        ends_a, ends_b = at[u[best[trees]]], at[v[best[trees]]]
        to[trees] = np.where(ends_a == trees, ends_b, ends_a)
        root = trees[(to[to[trees]] == trees) & (trees < to[trees])]
        to[root] = root
        while (to != to[to]).any():
            to = to[to]
        chosen.append(np.unique(best[trees]))
        at = to[at]
    return order[np.concatenate(chosen)] if chosen else order[:0]


def meeting(rows: DataFrame, per_block: int) -> DataFrame:
    """``key, first, second, own, id, part``: texts of a key in every pair of blocks where they meet texts of other parts.

    ``rows`` has ``key, id, part, size``; a block holds texts of about ``per_block`` in sum. The largest part of a key is
    not compared within itself. The others, in blocks, meet each other's blocks and its blocks.
    """
    parts = rows.groupBy("key", "part").agg(F.sum("size").alias("n"))
    keys = parts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(per_block)).cast("int")
    keys = keys.select("key", F.col("main.part").alias("main"), blocks(F.col("main.n")).alias("inner"), blocks(F.col("n") - F.col("main.n")).alias("outer"))
    rows = rows.join(keys, "key").withColumn("in_main", F.col("part") == F.col("main"))
    own = F.expr("cast(if(in_main, outer + pmod(xxhash64(id, key), inner), pmod(xxhash64(id, key), outer)) as int)")
    meets = F.expr("explode(sequence(0, if(in_main, outer, outer + inner) - 1))")
    rows = rows.select("key", "id", "part", own.alias("own"), meets.alias("other"))
    return rows.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "id", "part")


def across(pdf: pd.DataFrame, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, j of different parts in two blocks that meet whose signatures agree in enough positions, and in how many.

    With ``once`` a pair comes up at the least of its common keys only (if few texts share that key, its pairs were all tried).
    """
    own, part, key = pdf["own"].to_numpy(), pdf["part"].to_numpy(), pdf["key"].iloc[0]
    first, second = pdf["first"].iloc[0], pdf["second"].iloc[0]
    signs = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(-1, POSITIONS)
    keys = np.stack(pdf["keys"].to_numpy()) if once else None
    left, right, found = np.flatnonzero(own == first), np.flatnonzero(own == second), []
    columns = np.ascontiguousarray(signs[right].T)
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        agree = np.zeros((len(some), len(right)), np.uint8)
        for k in range(POSITIONS):
            agree += signs[some, k, None] == columns[k]
        agree[part[some, None] == part[right]] = 0
        if first == second:
            agree[some[:, None] >= right] = 0
        i, j = np.nonzero(agree >= LIKELY)
        if once and len(i):
            same = np.where(keys[some[i]] == keys[right[j]], keys[some[i]], np.iinfo(np.int64).max)
            i, j = (x[same.min(1) == key] for x in (i, j))
        found.append((some[i], right[j], agree[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def _membership(members: DataFrame, part: DataFrame) -> DataFrame:
    rows = members.select("key", "id").join(part, "id", "left")
    return rows.select("key", "id", F.coalesce("part", "id").alias("part"), F.lit(1).alias("size"))


def likely_trees(members: DataFrame, part: DataFrame, signs: DataFrame) -> DataFrame:
    """Edges of a spanning forest of the likely pairs in different parts, of each two blocks that meet."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, parts = pdf["id"].to_numpy(), pdf["part"].to_numpy()
        i, j, agree = across(pdf, False)
        kept = forest(parts[i], parts[j], agree)
        a, b = ids[i[kept]], ids[j[kept]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    rows = meeting(_membership(members, part), BLOCK).join(signs.select("id", "signature"), "id")
    return rows.groupBy("key", "first", "second").applyInPandas(compare, "a long, b long").distinct()


def shingled(docs: DataFrame, ids: DataFrame, idf: np.ndarray) -> DataFrame:
    """``id, size, shingles, weights`` of some texts: ascending 64-bit hashes and doubles, as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)
    schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("shingles", pa.binary()), ("weights", pa.binary())])

    @freeing(shingler)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, idf = shingler(), sent.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles, counts = make(words_of(text))
                rows.append((key, len(shingles), shingles.tobytes(), weights(shingles, counts, idf).astype(float).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    texts = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "text")
    return texts.mapInArrow(run, "id long, size int, shingles binary, weights binary")


def similarities(shingles: list[np.ndarray], weight: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of the texts i and j. One text is laid out over all shingles of the block and met by its partners at once."""
    size = np.array([len(x) for x in shingles])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    _, place = np.unique(np.concatenate(shingles), return_inverse=True)
    flat, total = np.concatenate(weight), np.array([w.sum() for w in weight])
    laid, out = np.zeros(place.max() + 1), np.empty(len(i))
    order = np.argsort(i, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        one = i[run[0]]
        mine = slice(start[one], start[one] + size[one])
        laid[place[mine]] = flat[mine]
        for at in range(0, len(run), 256):
            some = run[at : at + 256]
            n = size[j[some]]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            cells = np.repeat(start[j[some]] - begin, n) + np.arange(n.sum())
            low = np.add.reduceat(np.minimum(laid[place[cells]], flat[cells]), begin)
            out[some] = low / (total[one] + total[j[some]] - low)
        laid[place[mine]] = 0.0
    return out


def linked_across(members: DataFrame, part: DataFrame, signs: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """``a, b, similarity``: links between texts of different parts of a key, so many that they join all that any link joins.

    Texts with a likely partner are told first (a row each, not one for each pair). Their shingles go to the tasks, in
    blocks of a bounded number of shingles; a task compares its likely pairs exactly and keeps a spanning forest of those
    that hold.
    """
    members = _membership(members, part)
    known = signs.select("id", "signature", "keys")

    def touched(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = across(pdf, True)
        at = np.unique(np.concatenate([i, j]))
        return pdf.iloc[at][["key", "id", "part"]]

    met = meeting(members, BLOCK).join(known, "id").groupBy("key", "first", "second").applyInPandas(touched, "key long, id long, part long")
    met = stored(met.distinct(), "touched")
    texts = stored(shingled(docs, met.select("id").distinct(), idf), "shingles")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, parts = pdf["id"].to_numpy(), pdf["part"].to_numpy()
        i, j, _ = across(pdf, True)
        if not len(i):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        similar = similarities([np.frombuffer(x, np.uint64) for x in pdf["shingles"]], [np.frombuffer(x) for x in pdf["weights"]], i, j)
        hold = similar >= threshold
        i, j, similar = i[hold], j[hold], similar[hold]
        kept = forest(parts[i], parts[j], similar * 1e6)
        a, b = ids[i[kept]], ids[j[kept]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": similar[kept]})

    sized = met.join(texts.select("id", "size"), "id")
    rows = meeting(sized, SHINGLES).join(known, "id").join(texts.drop("size"), "id")
    return rows.groupBy("key", "first", "second").applyInPandas(verify, "a long, b long, similarity double")


def links(docs: DataFrame, signs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """``a, b, similarity`` of verified pairs; ``signs`` has ``id, keys, signature`` of distinct texts."""
    members = signs.select("id", F.explode("keys").alias("key"))
    shared = stored(counted(members), "shared_keys")
    small = all_pairs(shared.where(F.col("n") <= SMALL))
    crowd = shared.where(F.col("n") > SMALL)
    standing = crowd.groupBy("id").agg(F.sum("n").alias("standing"))
    crowd = stored(crowd.select("key", "id").join(standing, "id"), "crowded_keys")
    pivots = crowd.groupBy("key").agg(F.max(F.struct("standing", (-F.col("id")).alias("least"), F.col("id").alias("pivot"))).alias("p")).select("key", "p.pivot")
    starred = crowd.join(pivots, "key").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    tried = stored(likely(small.union(starred).distinct(), signs), "likely_pairs")
    found = stored(verified(tried, docs, idf, threshold), "verified_pairs")
    if crowd.isEmpty():
        return found
    parts = lambda: stored(components(found).withColumnRenamed("component", "part"), "parts")
    # Trees first: they join what a link joins, so that few texts have partners across when all pairs are compared.
    trees = stored(likely_trees(crowd, parts(), signs).join(tried, ["a", "b"], "left_anti"), "likely_pairs")
    if not trees.isEmpty():
        found = found.union(stored(verified(trees, docs, idf, threshold), "verified_pairs"))
    return found.union(stored(linked_across(crowd, parts(), signs, docs, idf, threshold), "links_across"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, copies`` for each row of ``docs``; class_id is the smallest id of the class."""
    docs = docs.select("doc_id", "text")
    survey = stored(surveyed(docs), "survey")
    idf = idf_factors(survey)
    rows = survey.where("block IS NULL").select("doc_id", "high", "low", "n")
    exact = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    signs = signatures(docs, idf).join(exact.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    signs = stored(signs.withColumnRenamed("doc_id", "id"), "signatures")
    found = links(docs, signs, idf, threshold)
    member = stored(rows.join(exact, ["high", "low"], "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"), F.coalesce("copies", F.lit(1)).alias("copies"), "n"), "members")
    # Rows that share an id tie their first copies together.
    edges = found.select("a", "b").union(member.where("first <> doc_id AND n > 0").select(F.col("first"), "doc_id"))
    classes = components(edges).select(F.col("id").alias("doc_id"), "component")
    return member.join(classes, "doc_id", "left").select("doc_id", F.coalesce("component", "first").alias("class_id"), "copies")


def without_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each class stays: the one of the smallest id.

    Rows that share an id but not their text are documents of their own; of rows that share both one stays.
    """
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        dropped = stored(near_duplicates(docs, threshold).where("class_id <> doc_id").select("doc_id").distinct(), "dropped")
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    keyed = docs.withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), threshold)
    classes = found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_key"), "class_id").distinct()
    first = classes.join(keyed.select("_key", "doc_id"), "_key").groupBy("class_id").agg(F.min(F.struct("doc_id", "_key")).alias("first"))
    first = stored(first.select("first._key"), "kept")
    kept = keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(docs.columns).union(docs.where("doc_id IS NULL"))


@query("op4_minhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))
