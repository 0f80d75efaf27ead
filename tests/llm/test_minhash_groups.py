"""Near duplicates in large groups: exact weighted similarity against dictionaries, and few rows where all pairs are likely and none holds."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorgate.llm import minhash
from sensorgate.llm.common import stored


def family(n, edits, seed, words=200):
    """A text and n copies of it, each with its own words in some places."""
    r = random.Random(seed)
    base = [f"b{seed}w{k}" for k in range(words)]
    out = [base]
    for k in range(n):
        places = r.sample(range(2, words - 2, 6), edits)
        out.append([f"n{seed}x{k}p{i}" if i in places else w for i, w in enumerate(base)])
    return [" ".join(w) for w in out]


def weighted(text, idf):
    words = text.lower().split()
    out = {}
    for shingle, n in Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))).items():
        hashed = minhash.shingler()(list(shingle))[0][0]
        out[shingle] = (1 + math.log(n)) * float(idf[int(hashed & np.uint64(minhash.COUNTERS - 1))])
    return out


def jaccard(a, b):
    low = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


def prepared(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    survey = stored(minhash.surveyed(df), "survey")
    idf = minhash.idf_factors(survey)
    signs = stored(minhash.signatures(df, idf).withColumnRenamed("doc_id", "id"), "signs")
    return df, idf, signs


def test_similarities_are_exact():
    idf = np.random.default_rng(1).uniform(1, 1.25, minhash.COUNTERS).astype(np.float32)
    texts = [*family(6, 4, 1), *family(5, 9, 2, 90), "one two three", "a a a a a a a a b"]
    made = [minhash.shingler()(t.split()) for t in texts]
    weight = [minhash.weights(*m, idf).astype(float) for m in made]
    i, j = np.triu_indices(len(texts), 1)
    got = minhash.similarities([m[0] for m in made], weight, i, j)
    plain = [weighted(t, idf) for t in texts]
    assert got == pytest.approx([jaccard(plain[a], plain[b]) for a, b in zip(i, j)], abs=1e-6)


@pytest.mark.parametrize("shingles", [1_000_000, 3_000])
def test_classes_by_brute_force_with_weights(spark, monkeypatch, shingles):
    monkeypatch.setattr(minhash, "SHINGLES", shingles)
    monkeypatch.setattr(minhash, "BLOCK", 40)
    texts = [*family(60, 3, 3), *family(40, 3, 4), *family(30, 2, 5), *family(3, 1, 6)]
    df, idf, _ = prepared(spark, texts)
    plain = [weighted(t, idf) for t in texts]
    at = list(range(len(texts)))
    close = 0
    for i in range(len(texts)):
        for j in range(i):
            similar = jaccard(plain[i], plain[j])
            close += abs(similar - 0.8) < 1e-5
            if similar >= 0.8:
                a, b = sorted((at[i], at[j]))
                at = [a if p == b else p for p in at]
    assert not close
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == dict(enumerate(at))


def test_likely_pairs_that_do_not_hold_make_no_rows(spark):
    """Copies at a similarity of about 0.85 to their base and 0.73 to each other, the base left out: all pairs are likely."""
    texts = family(150, 3, 7)[1:]
    df, idf, signs = prepared(spark, texts)
    one_key = signs.select("id", F.array(F.lit(1).cast("long")).alias("keys"), "signature")
    crowd, none = one_key.select("id", F.lit(1).cast("long").alias("key")), spark.createDataFrame([], "id long, part long")
    plain = [weighted(t, idf) for t in texts]
    want = sum(jaccard(plain[i], plain[j]) >= 0.8 for i in range(150) for j in range(i))
    trees = minhash.likely_trees(crowd, none, one_key)
    assert trees.count() < 2 * 150  # a tree for each two blocks that meet
    got = minhash.linked_across(crowd, none, one_key, df, idf, 0.8)
    assert got.count() <= min(want, 2 * 150) and (want == 0 or got.count() > 0)
