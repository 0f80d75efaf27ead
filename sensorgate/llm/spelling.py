"""Groups of spelling variants: exact neighbours at one edit by a dictionary of pairs of trie nodes.

All words are put in a trie, their reversals in another, and the nodes of both are numbered. A word of length L then is
L + 1 pairs (node of its prefix, node of its suffix) where nothing is left out, and L pairs where one position is skipped.
Two words differ by one replaced letter if they share a skipped pair; a word with one letter more shares a skipped pair
with a whole pair of the other. Equal pairs mean equal strings, so nothing has to be verified, and a pair of integers
stands for words of any length. The words of one skipped pair differ in one letter: they are as many as the alphabet
has letters at most, which bounds every group. A letter inside a run of equal ones is left out at the first of them
only, so every neighbour is met once.

Tries are numbered in sorted order: a word's new nodes are those below the prefix that it shares with the word before.
Words are cut in ranges; what crosses a border is numbered on the driver from one pair of words for each border (the last
word before, the first one after), all other nodes inside their range, from an offset on. Numbers have gaps.

A word's form is its neighbour of largest count, if that is large enough; roots follow forms to the end by doubling the
steps (counts grow tenfold with each step, so a few rounds end it).

Defined cases: a null text has no words; a null id is hashed as an empty string; repeated rows count again; words may be
of any length; ties in counts take the smallest word in code-point order; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm.common import query, stored, table

#: Letters A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, TIMES, DROPPED = 7, 2, 10, 31
#: Distinct words that a task counts before it passes them on, words of a range of a trie, node numbers of a batch.
HELD, RANGE, BATCH = 300_000, 100_000, 1_000_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(doc_id, text: str | None, shortest: int = SHORTEST, dropped: int = DROPPED) -> Counter:
    """Words of a text with their counts: runs of letters in lower case (A-Z only), of which one in ``dropped`` lost a letter."""
    found: Counter = Counter()
    key = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(re.findall(f"[{LETTERS}]{{{shortest},}}", text or "")).items():
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        h = crc32(word.encode(), key)
        if h % dropped == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < shortest:
                continue
        found[word] += n
    return found


def _counted(batches):
    def rows():
        return pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    held: Counter = Counter()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                held.update(words_of(doc_id, text))
            if len(held) > HELD:
                yield rows()
                held = Counter()
    yield rows()


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``word, n`` of all words with at least so many occurrences."""
    counts = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving: slices are compared at the speed of memory."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Path:
    """Numbers of the nodes on a prefix, by depth; stored as runs of consecutive ones."""

    def __init__(self, text: str = "", runs: tuple = ((0, 0),)):
        self.text, self.runs = text, runs

    def moved(self, text: str, number: int) -> tuple[Path, int]:
        """The path of another prefix: nodes below the shared part get numbers from ``number`` on; also the next free one."""
        same = shared(self.text, text)
        runs = tuple(r for r in self.runs if r[0] <= same)
        if len(text) > same:
            runs += ((same + 1, number),)
        return Path(text, runs), number + len(text) - same

    def numbers(self, depth: int) -> list[int]:
        """Of the nodes from depth 0 to ``depth``."""
        out: list[int] = []
        for k, (start, number) in enumerate(self.runs):
            end = min(self.runs[k + 1][0] if k + 1 < len(self.runs) else depth + 1, depth + 1)
            out.extend(range(number, number + end - start))
        return out


def _number(borders: dict):
    """Numbers the words of whole ranges; rows come by range, and in it by word."""
    kind = pa.schema([("id", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("nodes", pa.list_(pa.int64()))])

    def run(batches):
        now, held = None, 0
        out: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for part, word, n in zip(batch["part"].to_pylist(), batch["key"].to_pylist(), batch["n"].to_pylist(), strict=True):
                if part != now:
                    now, (left, right, number, rank) = part, borders[part]
                    before, path, ahead = left.text, left.numbers(len(left.text)), right.numbers(len(right.text))
                same, border = shared(before, word), shared(right.text, word)
                del path[same + 1 :]
                if border > same:  # on the way to the next range: numbered with the border
                    path.extend(ahead[same + 1 : border + 1])
                fresh = len(word) + 1 - len(path)
                path.extend(range(number, number + fresh))
                number += fresh
                for values, value in zip(out, (rank, word, n, path.copy()), strict=True):
                    values.append(value)
                before, rank, held = word, rank + 1, held + len(path)
                if held > BATCH:
                    yield pa.RecordBatch.from_pydict(dict(zip(kind.names, out, strict=True)), kind)
                    out, held = ([], [], [], []), 0
        yield pa.RecordBatch.from_pydict(dict(zip(kind.names, out, strict=True)), kind)

    return run


def trie(words: DataFrame, key: str = "key") -> DataFrame:
    """``id, word, n, nodes`` of distinct strings: rank in code-point order, and the trie's nodes from the root to the word."""
    ranges = max(1, math.ceil(words.count() / RANGE))
    cut = stored(words.select(F.col(key).alias("key"), "n").repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "ranges")
    ends = cut.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum(F.length("key")).alias("chars"), F.count("*").alias("words"))
    ends = ends.orderBy("part").collect()  # one row for each range
    paths, number = [Path()], 1
    for a, b in zip(ends, ends[1:], strict=False):
        path, number = paths[-1].moved(b["first"][: shared(a["last"], b["first"])], number)
        paths.append(path)
    paths.append(Path())
    borders, rank = {}, 0
    for k, end in enumerate(ends):
        borders[end["part"]] = (paths[k], paths[k + 1], number, rank)
        number, rank = number + end["chars"], rank + end["words"]
    by_range = cut.repartition("part").sortWithinPartitions("part", "key").select("part", "key", "n")
    return by_range.mapInArrow(_number(borders), "id long, word string, n long, nodes array<long>")


def node_pairs(words: DataFrame) -> DataFrame:
    """``p, s, id, n, kind`` of all words (``id, word, n, nodes, ends``, the nodes of prefixes and of suffixes).

    Kind 0: nothing is left out between prefix and suffix, 1: one letter that differs from the one before it, 2: another.
    """
    whole = "transform(nodes, (p, i) -> struct(p, get(ends, size(nodes) - 1 - i) AS s, 0 AS kind))"
    skipped = "transform(slice(nodes, 1, size(nodes) - 1), (p, i) -> struct(p, get(ends, size(nodes) - 2 - i) AS s, if(i > 0 AND get(letters, i) = get(letters, i - 1), 2, 1) AS kind))"
    rows = words.withColumn("letters", F.split("word", "")).select("id", "n", F.expr(f"concat({whole}, {skipped})").alias("pairs"))
    # explode_outer: no array is empty, and the planner would test that by making each array once more.
    return rows.select("id", "n", F.explode_outer("pairs").alias("x")).select("x.p", "x.s", "id", "n", "x.kind")


def neighbours(pairs: DataFrame) -> DataFrame:
    """``id, n, n_near`` of each word that has neighbours, and the one of largest count: ``near`` as (n, -id)."""
    groups = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("id", "n", "kind")).alias("all")).where("size(all) > 1")
    other = "x.id <> y.id AND (x.kind > 0 AND y.kind > 0 OR x.kind + y.kind = 1)"
    met = groups.select(F.explode_outer(F.expr(f"transform(all, x -> struct(x.id, x.n, transform(filter(all, y -> {other}), y -> struct(y.n, -y.id AS id)) AS near))")).alias("x"))
    met = met.select("x.id", "x.n", "x.near").where("size(near) > 0")
    return met.groupBy("id", "n").agg(F.sum(F.size("near")).cast("long").alias("n_near"), F.max(F.array_max("near")).alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` from ``id, form``: where a chain of forms ends."""
    steps = stored(forms.select("id", F.col("form").alias("root")), "steps")
    while True:
        joined = steps.alias("a").join(steps.alias("b"), F.col("a.root") == F.col("b.id"), "left")
        further = stored(joined.select("a.id", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "steps")
        if further.where("moved").isEmpty():
            return further.select("id", "root")
        steps = further.select("id", "root")


def variants(docs: DataFrame, least: int = LEAST, times: float = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = stored(vocabulary(docs, least), "words")
    ahead = trie(words, "word")
    back = trie(words.select(F.reverse("word").alias("key"), "n")).select(F.reverse("word").alias("word"), F.col("nodes").alias("ends"))
    both = stored(ahead.join(back, "word"), "nodes")
    near = stored(neighbours(node_pairs(both)), "near")
    forms = near.where(F.col("near.n") >= times * F.col("n")).select("id", (-F.col("near.id")).alias("form"), F.col("near.n").alias("form_n"))
    ends = roots(forms)
    named = both.select("id", "word")
    last = named.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    first = named.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    chosen = forms.join(ends, "id").join(first, "form").join(last, "root").select("id", "form_word", "form_n", "root_word")
    out = both.select("id", "word", "n").join(near.select("id", "n_near"), "id", "left").join(chosen, "id", "left")
    return out.select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        "form_n",
    )


@query("op13_spelling_variants")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return variants(table(spark, folder, "documents"))
