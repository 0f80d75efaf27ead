"""Document fingerprints by order MinHash, in SQL functions only.

The words of a text (split at single spaces) give k-mers of ``K`` consecutive words. Equal k-mers of a text are numbered
by occurrence, so that repeats count. Each numbered k-mer has a hash; the ``KEPT`` k-mers of least hash are selected and
put back in the order of the text, and each tuple of ``TUPLE`` neighbours in that order is hashed. The set of these tuple
hashes is the fingerprint. A tuple survives only if its k-mers survive and keep their order, so the likeness of two
fingerprints (Jaccard similarity of their tuples) falls with insertions, deletions and moved passages alike.

All steps work on sorted arrays of longs: 36 bits of hash and 28 of position. In the array sorted by k-mer, the number of
an occurrence is the distance to the first equal one, found by doubling steps only where a neighbour is equal.

Defined cases: a null text is an empty one; a text of fewer than K words has one k-mer, an empty text one of no words;
with a single k-mer the tuple is that k-mer; equal texts have equal fingerprints; texts may have up to 2**28 words;
repeated rows of (doc_id, text) are one document in the order of documents and all get its results; rows that share an id
are ordered by the hashes of their texts; null ids come last; in a table of one document the next one is itself; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorgate.llm.common import documents, query, stored

K, KEPT, TUPLE = 2, 64, 2
PLACE = (1 << 28) - 1
CUTS = 255


def _with_prints(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the sorted distinct tuple hashes of a text column. One select per step: none is evaluated inside another's loop."""
    df = df.withColumn("_w", F.split(F.col(text), " "))
    # Hash of each k-mer in the high bits, its position below.
    kmer = ", ".join(f"get(_w, i + {k})" for k in range(K))
    df = df.withColumn("_s", F.expr(f"sort_array(transform(sequence(0, greatest(size(_w) - {K}, 0)), i -> (xxhash64({kmer}) & ~{PLACE}L) | i))")).drop("_w")
    # Number of equal k-mers before: powers of two, from the largest on, as long as the k-mer so far back is the same.
    steps = ", ".join(str(1 << b) for b in range(27, -1, -1))
    back = f"aggregate(filter(array({steps}), t -> t <= i), 0, (d, t) -> if(i - d - t >= 0 AND shiftright(get(_s, i - d - t), 28) = shiftright(v, 28), d + t, d))"
    number = f"if(i > 0 AND shiftright(get(_s, i - 1), 28) = shiftright(v, 28), {back}, 0)"
    df = df.withColumn("_t", F.expr(f"slice(sort_array(transform(_s, (v, i) -> (xxhash64(shiftright(v, 28), {number}) & ~{PLACE}L) | (v & {PLACE}L))), 1, {KEPT})")).drop("_s")
    # Back in the order of the text: position in the high bits.
    df = df.withColumn("_t", F.expr(f"transform(sort_array(transform(_t, v -> shiftleft(v & {PLACE}L, 36) | shiftrightunsigned(v, 28))), v -> v & {(1 << 36) - 1}L)"))
    part = ", ".join(f"get(_t, i + {k})" for k in range(TUPLE))
    return df.withColumn(out, F.expr(f"array_sort(array_distinct(transform(sequence(0, greatest(size(_t) - {TUPLE}, 0)), i -> cast(shiftright(xxhash64({part}), 32) as int))))")).drop("_t")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints, 0 to 1."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def shown(prints: str) -> Column:
    return F.concat_ws("", F.transform(prints, lambda v: F.lpad(F.hex(v.bitwiseAND(0xFFFFFFFF)), 8, "0")))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, tie, text``; (doc_id, tie) names a document. Null ids get the least number, beyond a flag in the tie."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("tie", F.xxhash64("text", F.col("doc_id").isNull())).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, prints`` for each row: fingerprints as arrays of 32-bit tuple hashes."""
    return _with_prints(keyed(docs).withColumn("n_chars", F.length("text")), "text", "prints").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "prints")


def successors(rows: DataFrame) -> DataFrame:
    """``id, tie, next_id, next_tie``: the next document in descending id, after the last one the first.

    ``rows`` has distinct ``id, tie``. Ids are cut into ranges at approximate quantiles, which are ids of the table; the
    last document of a range sees the first of the next one through a copy of that row.
    """
    cuts = sorted({int(c) for c in rows.approxQuantile("id", [k / CUTS for k in range(CUTS + 1)], 0.001)}) or [0]
    top = rows.orderBy(F.desc("id"), "tie").first()
    # Range 1 holds the largest ids.
    ranged = rows.select("id", "tie", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c >= F.col("id"))).alias("block"), F.lit(False).alias("copy"))
    heads = ranged.groupBy("block").agg(F.max(F.struct("id", F.bitwise_not("tie").alias("flipped"), "tie")).alias("h"))
    order = Window.orderBy("block")  # as many rows as ranges
    heads = heads.select("h.id", "h.tie", F.lag("block").over(order).alias("block"), F.lit(True).alias("copy")).where("block IS NOT NULL")
    within = Window.partitionBy("block").orderBy("copy", F.desc("id"), "tie")
    both = ranged.union(heads).select("id", "tie", "copy", F.lead("id").over(within).alias("next_id"), F.lead("tie").over(within).alias("next_tie"))
    last = [F.lit(None if top is None else top[c]).cast("bigint") for c in ("id", "tie")]
    return both.where("NOT copy").select("id", "tie", F.coalesce("next_id", last[0]).alias("next_id"), F.coalesce("next_tie", last[1]).alias("next_tie"))


@query("op6_order_minhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(documents(spark, folder))
    prints = stored(_with_prints(docs.withColumn("n_chars", F.length("text")), "text", "prints").select("id", "tie", "n_chars", "prints"), "prints")
    repeated = not prints.groupBy("id", "tie").count().where("count > 1").isEmpty()
    once = (lambda df: df.dropDuplicates(["id", "tie"])) if repeated else (lambda df: df)
    prints = once(prints)
    pairs = successors(prints.select("id", "tie"))
    third = F.floor(F.col("n_chars") / 3).cast("int").alias("third")
    asked = stored(pairs.join(prints.select("id", "tie", "n_chars"), ["id", "tie"]).select(F.col("next_id").alias("id"), F.col("next_tie").alias("tie"), F.col("id").alias("to_id"), F.col("tie").alias("to_tie"), third), "asked")
    # Each document tells the one before it the head of its text and its fingerprint. Texts and fingerprints are shuffled
    # once, by the document's key, for both joins.
    texts = docs.select("id", "tie", "text")
    told = once(texts).join(asked, ["id", "tie"]).join(prints, ["id", "tie"])
    told = told.select(F.col("to_id").alias("id"), F.col("to_tie").alias("tie"), F.expr("substring(text, 1, third)").alias("head"), "third", F.col("prints").alias("next_prints"))
    out = texts.join(told, ["id", "tie"]).join(prints, ["id", "tie"])
    edited = F.concat(F.expr("substring(text, 1, n_chars - third)"), "head")
    out = _with_prints(out.withColumn("edited", edited).drop("text", "head"), "edited", "edited_prints")
    return out.select(
        F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        shown("prints").alias("fingerprint"),
        shown("edited_prints").alias("edited_fingerprint"),
        likeness("prints", "edited_prints").alias("near_edited"),
        likeness("prints", "next_prints").alias("near_next"),
    )
