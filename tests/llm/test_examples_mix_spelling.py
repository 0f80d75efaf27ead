"""Fill-in-the-middle, source mixing and spelling variants against plain loops, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sensorgate.llm import fill_middle, mixing, spelling
from sensorgate.llm.common import stored

SCHEMA = "doc_id long, text string, source string, form string, size long, n long, word string, _doc string"
rng = random.Random(11)


def lines(n):
    return "".join(rng.choice(["a b", "", "é\r", "$1 \\ {2}", "𝄞 x"]) + rng.choice(["\n", "\n", "\n\n"]) for _ in range(n)) + rng.choice(["", "end"])


TEXTS = [None, "", "\n", "one", "\n\nx", "has <P> mark", "<M>", "almost < P> <", "<S", "M>\n<S\n>P>\n", *(lines(n) for n in (1, 2, 3, 5, 9, 40, 3000)), "w " * 50_000, "x" * 200_000]


def frame(spark, texts, sources=("b", "a", None, "")):
    rows = [(k, t, sources[k % len(sources)], "f", 1, 2, "w", "d") for k, t in enumerate(texts)]
    rows += [rows[min(3, len(rows) - 1)], (None, "no id\nat all\n", "a", None, None, None, None, None), (3, "other text of id 3\n", None, "", 0, 0, "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return stored(frame(spark, TEXTS), "odd").repartition(3)


def cut(doc_id, text, rate=100, spm_rate=50):
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", text, None, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", p, m, s
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", p, m, s


@pytest.mark.parametrize("rates", [(100, 50), (40, 100), (100, 0)])
def test_fill_in_middle(docs, rates):
    out = fill_middle.with_parts(fill_middle.examples(docs, 7, *rates)).select("doc_id", "text", "n", "form", "output", "prefix", "middle", "suffix", "restored").collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n, r.form, r.output, r.prefix, r.middle, r.suffix) == cut(r.doc_id, r.text, *rates)
        assert r.restored == r.text


def test_fill_in_middle_empty(docs):
    assert fill_middle.with_parts(fill_middle.examples(docs.where("false"))).count() == 0


def level_of(caps, weights, budget):
    """Targets by bisection on the level, another way than the operator's."""
    low, high = 0.0, float(budget) + 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(c, middle * w) for c, w in zip(caps, weights)) < budget else (low, middle)
    return [min(c, high * w) for c, w in zip(caps, weights)]


def test_targets(spark):
    for sizes in ({"a": 5, "b": 900, "c": 40, None: 3, "": 0, "é": 77}, {"x": 1, "y": 1}, {None: 10}, {"z": 0}, {f"s{k:03}": k * k for k in range(40)}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
        weights = [(5, 2, 1)[k % 3] for k in range(len(names))]
        want = level_of([3 * sizes[s] for s in names], weights, sum(sizes.values()))
        assert [got[s] for s in names] == pytest.approx(want, rel=1e-9, abs=1e-6)
    assert mixing.targets(rows.where("false")).count() == 0


@pytest.mark.parametrize("few, step", [(10_000, 12), (3, 4), (1, 20)])
def test_mix_is_nearest_to_its_target(spark, monkeypatch, few, step):
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "STEP", step)
    r = random.Random(3)
    texts = [" ".join("w" * r.randint(1, 30)) if r.random() < 0.9 else None for _ in range(300)] + ["one \x0b two\x1f \x85 three", "big " * 4000]
    table = frame(spark, texts, ("hot", "hot", "b", "a", None, "c", "hot"))
    rows, plan = mixing.plan_mix(table)
    plan = {p.source: p for p in plan.collect()}
    taken, spots = Counter(), defaultdict(Counter)
    for d in rows.collect():
        p = plan[d.source]
        times = min(3, p.whole + (d.spot < p.limit))
        taken[d.source] += times * d["size"]
        spots[d.source][d.spot] += d["size"]
    for s, p in plan.items():
        through, reach = 0, [0]
        for _, n in sorted(spots[s].items()):
            through += n
            reach.append(through)
        want = p.target - p.whole * p.source_size
        assert abs(taken[s] - p.target) == pytest.approx(min(abs(x - want) for x in reach), abs=1e-6)
    again = {p.source: p for p in mixing.plan_mix(table.repartition(5))[1].collect()}
    assert again == plan


def test_draw_repeats_whole_rows(spark, docs):
    rows, plan = mixing.plan_mix(docs)
    drawn = mixing.draw(docs, plan)
    assert drawn.schema == docs.schema
    want = sum(d["size"] * min(3, p.whole + (d.spot < p.limit)) for p in plan.collect() for d in rows.where(F.col("source").eqNullSafe(F.lit(p.source))).collect())
    assert drawn.agg(F.sum(mixing.words("text"))).first()[0] == want
    rows, plan = mixing.plan_mix(docs.where("false"))
    assert mixing.draw(docs.where("false"), plan).count() == 0 and rows.count() == 0


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    found = {w: sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v)) for w in counts}
    form = {w: vs[0] if vs and counts[vs[0]] >= 10 * counts[w] else None for w, vs in found.items()}
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(found[w]), counts.get(form[w]))
    return out


@pytest.mark.parametrize("size", [100_000, 3])
def test_spelling(spark, monkeypatch, size):
    monkeypatch.setattr(spelling, "RANGE", size)
    r = random.Random(7)
    texts = [None, "", "short words only", "Élémentaire élémentaire Straße×÷x straße×÷x 1234567 abcdefg_abcdefg"]
    for base in ("aabbaabb", "mississippi", "ÀÿÀÿÀÿÀÿ", "zzzzzzzz"):
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice(["", r.choice("abmsz"), w[k] + r.choice("abmsz"), w[k]])
            texts.append(" ".join(["".join(w)] * r.choice([1, 2, 3, 25, 300])))
    table = frame(spark, [*texts, *texts])
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(table).collect()}
    assert got == plain_variants(table.select("doc_id", "text").collect())
    assert any(f for f, *_ in got.values()) and any(w != root and root != f for w, (f, root, *_) in got.items())


def test_spelling_of_very_long_words(spark):
    long = "ab" * 20_000
    table = frame(spark, [f"{long} {long} {long}c {long}c x{long[1:]} x{long[1:]}"] * 2)
    got = {x.word[:1] + x.word[-1:]: x.n_near for x in spelling.variants(table, least=3).collect() if len(x.word) >= 39_999}
    assert got == {"ab": 2, "ac": 1, "xb": 1}
    assert spelling.variants(table.where("false")).count() == 0
