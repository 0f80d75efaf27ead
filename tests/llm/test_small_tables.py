"""Each operator and stage on small tables with nulls, empty and long texts, repeats, no rows and clashing columns."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sensorgate.llm import bpe_automaton, embeddings, html_text, minhash, order_minhash, packing, quality, suffixes, token_files, urls
from sensorgate.llm.common import BYTE_VOCAB, WORD_VOCAB, crc32, stored
from sensorgate.session import scratch_path

tokenizers = pytest.importorskip("tokenizers")
rng = random.Random(5)


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join("".join(r.choice(["tha", "ou", "re", "én", "in", "ß", "go"]) for _ in range(r.randint(1, 4))) + r.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


LONG = prose(30_000, 1)
TEXTS = [None, "", " ", "One word", "It's <|endoftext|> 12 İ Σ é\x1c x  y\n\n z ", prose(80, 2), prose(80, 2), prose(400, 3), LONG, "a" * 900, prose(30, 4) + prose(90, 3)]


def frame(spark, texts=TEXTS, extra=True):
    rows = [(k, t, "en", f"src{k % 3}", len(t or ""), 7, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class_id int, sequence_id string")
    return df if extra else df.drop("class_id", "sequence_id")


@pytest.fixture(scope="module")
def docs(spark):
    again = frame(spark).where("doc_id = 5")  # a repeated row
    none = frame(spark).where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))
    return stored(frame(spark).union(again).union(none), "docs").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark).where("false")


def library(path):
    return tokenizers.Tokenizer.from_file(path)


def test_bpe_matches_the_library(docs, empty):
    t = library(WORD_VOCAB)
    rows = docs.select("doc_id", "text").join(bpe_automaton.round_trip(docs), "doc_id").collect()
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
    assert bpe_automaton.round_trip(docs).count() == 13 and bpe_automaton.round_trip(empty).count() == 0


def test_bpe_on_random_strings():
    t, own = library(WORD_VOCAB), bpe_automaton.WordTokenizer(WORD_VOCAB)
    parts = [*" \n\t\x1c\u3000ab'sdlret1.,\u00e9\u0301\u03a3\u0130\u65e5!", "<|endoftext|>", "aaaa", "haha"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    for text, (n, ids, decoded) in zip(texts, own(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), t.decode(want, skip_special_tokens=False))


def test_token_files(spark, docs, empty):
    place, t = scratch_path(spark, "tokens"), library(WORD_VOCAB)
    entries = stored(token_files.write_shards(docs, WORD_VOCAB, 2, place), "entries")
    index = token_files.build_index(entries, place)
    found = token_files.lookup(entries.select("doc_id", "copy"), index, place)
    show = lambda pdf, ids: pdf[["doc_id", "copy"]].assign(start=pdf["base"] + pdf["offset"], ids=[ids(r).tolist() for r in pdf.itertuples()])
    got = token_files.read_shards(found, token_files.shard_bases(entries), place, show, "doc_id long, copy long, start long, ids array<int>").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10] and [r.copy for r in got if r.doc_id == 5] == [0, 1]
    at = 0
    for r in got:
        text = TEXTS[7 if r.doc_id is None else r.doc_id] or ""
        assert r.start == at and r.ids == [*t.encode(text, add_special_tokens=False).ids, 2]
        at += len(r.ids)
    strangers = spark.range(1000, 1500).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("copy"))
    assert token_files.lookup(strangers, index, place).count() == 0
    assert token_files.write_shards(empty, WORD_VOCAB, 2, place).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64))
    mph, _ = token_files.PerfectHash.from_bytes(token_files.PerfectHash.build(keys).to_bytes())
    assert sorted(mph(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(np.array([3, 3], np.uint64))


def check_pieces(rows, limits=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= limits
    return by_doc, by_sequence


def test_packing(docs, empty):
    t = library(BYTE_VOCAB)
    rows = packing.pack_documents(docs.where("doc_id <> 5")).collect()
    by_doc, by_sequence = check_pieces(rows)
    for (doc, n), pieces in by_doc.items():
        ids = b"".join(p.ids for p in sorted(pieces, key=lambda p: p.start))
        want = [*t.encode(TEXTS[doc] or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want)
        assert all(p.ids_crc32 == crc32(np.frombuffer(p.ids, "<u4")) == zlib.crc32(p.ids) for p in pieces)
    for pieces in by_sequence.values():
        total = sum(n for _, n in pieces)
        assert total & (total - 1) == 0 or 2048 - total < 32
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == {None, *range(11)} and packing.pack_documents(empty).count() == 0


def test_packing_limits(docs):
    limits = packing.Limits(tokens=256, segments=4, loss_tokens=100)
    rows = packing.pack_documents(docs.withColumn("prompt_chars", F.lit(40)), limits=limits).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        assert len(pieces) <= 4 and sum(p.length for p in pieces) <= 256 and sum(p.loss_tokens for p in pieces) <= 100
    r = random.Random(3)
    for _ in range(30):
        lengths = [r.randint(0, 700) for _ in range(r.randint(1, 60))]
        masks = [r.choice([None, np.array([r.random() < 0.5 for _ in range(n)])]) for n in lengths]
        seen = [np.zeros(n, int) for n in lengths]
        for sequence in packing.pack_block(lengths, masks, limits):
            assert len(sequence) <= 4 and sum(p.length for p in sequence) <= 256 and sum(p.loss for p in sequence) <= 100
            for p in sequence:
                seen[p.example][p.start : p.start + p.length] += 1
                assert p.loss == packing.cut_losses(masks[p.example], p.start, p.length)
        assert all((s == 1).all() for s in seen)


def windows(texts, length):
    count = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    return count


@pytest.mark.parametrize("crowd", [512, 1])
def test_suffixes_by_brute_force(spark, docs, empty, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    passage = prose(60, 11)
    texts = [*TEXTS, *(prose(20, k) + passage + prose(20, 50 + k) for k in range(20, 26)), passage[:120], "ab" * 100]
    data = [(t or "").encode() for t in texts]
    length, found = 120, suffixes.keyed(frame(spark, texts).repartition(3))
    spans = {r.doc_id: suffixes.merged(r.spans) for r in suffixes.repeats(found, length).collect()}
    firsts = {r.doc_id: suffixes.merged(r.spans) for r in suffixes.repeats(found, length, first=True).collect()}
    count, seen = windows(data, length), set()
    for k, t in enumerate(data):
        all_, later = np.zeros(len(t), bool), np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            all_[i : i + length] |= count[w] > 1
            later[i : i + length] |= w in seen
            seen.add(w)
        for want, got in ((all_, spans.get(k, [])), (later, firsts.get(k, []))):
            mask = np.zeros(len(t), bool)
            for a, b in got:
                mask[a:b] = True
            assert (mask == want).all()
    assert suffixes.repeats(suffixes.keyed(empty), length).count() == 0
    cut = suffixes.remove_repeats(docs, length)
    assert cut.columns == docs.columns and cut.count() == docs.count() and suffixes.remove_repeats(empty, length).count() == 0


def test_minhash_by_brute_force(spark, docs, empty):
    base = [prose(120, 100 + k) for k in range(12)]
    texts = list(base)
    for k in range(60):  # a large group of near copies, and small ones
        words = base[0 if k < 40 else k % 12].split(" ")
        words[rng.randrange(len(words))] = f"new{k}"
        texts.append(" ".join(words))
    texts += [base[3], base[3].upper(), None, "", "one two", "one two", "three"]
    df = frame(spark, texts)
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    sets = [set(zip(*(w[k:] for k in range(5)), strict=False)) or {tuple(w)} if (w := (t or "").lower().split()) else set() for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and len(sets[i] & sets[j]) / union >= 0.84:
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    assert classes == dict(enumerate(parent))
    kept = minhash.without_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(parent))
    assert minhash.near_duplicates(empty).count() == 0
    some = minhash.without_copies(docs).collect()
    assert sorted(r.doc_id for r in some if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def edited(words, places, tag):
    return [f"{tag}x{k}" if k in places else w for k, w in enumerate(words)]


def lost_links(spark, keys):
    """Of 40 sub-families in large keys, a member near the central text and one near that member only: how many of their links are lost."""
    r, base = random.Random(21), [f"w{k}" for k in range(300)]
    near = [edited(base, set(r.sample(range(5, 295, 10), 5)), f"m{k}") for k in range(40)]
    far = [edited(w, set(r.sample(range(10, 295, 10), 5)), f"q{k}") for k, w in enumerate(near)]
    df = frame(spark, [" ".join(w) for w in [base, *near, *far]]).select("doc_id", "text")
    idf = np.ones(minhash.COUNTERS, np.float32)
    signs = minhash.signatures(df, idf).select(F.col("doc_id").alias("id"), F.array(*map(F.lit, keys)).cast("array<long>").alias("keys"), "signature")
    found = {(x.a, x.b) for x in minhash.links(df, stored(signs, "signs"), idf, 0.8).collect()}
    at = list(range(81))
    for _ in at:
        for a, b in found:
            at[a] = at[b] = min(at[a], at[b])
    return sum(at[1 + k] != 0 for k in range(40)) + sum(at[41 + k] != at[1 + k] for k in range(40))


def test_minhash_keeps_links_off_the_central_text(spark):
    assert lost_links(spark, [1, 2]) == 0


def test_minhash_keeps_links_of_a_single_large_key(spark):
    assert lost_links(spark, [1]) == 0


def test_rows_that_share_an_id_stay_with_their_own_texts(spark):
    a, b = prose(60, 500), prose(60, 501)
    df = spark.createDataFrame([(0, b), (1, a), (1, b), (2, a), (2, a)], "doc_id long, text string")
    assert sorted(minhash.without_copies(df).collect()) == sorted([(0, b), (1, a)])


def test_weighted_sampling_estimates_similarity():
    sample, n = minhash.Sampler(), 4000
    r = np.random.default_rng(2)
    shingles = np.sort(r.integers(0, 1 << 63, n, np.uint64))
    weight = r.uniform(0.5, 3, n).astype(np.float32)
    a, b = (shingles[:3400], weight[:3400]), (shingles[600:], weight[600:] * np.where(np.arange(3400) % 5, 1, 0.5).astype(np.float32))
    agree = np.mean(sample(*a) == sample(*b))
    assert abs(agree - minhash.weighted_jaccard(a, b)) < 0.15


def test_quality(spark, docs, empty):
    good, bad = [prose(60, 200 + k) for k in range(60)], [prose(60, 300 + k) + " trash junk trash" for k in range(60)]
    texts = [*good, *bad, None, "", LONG]
    df = frame(spark, texts)
    ratings = spark.createDataFrame([(k, 2 if k < 60 else k % 2) for k in range(0, 120, 2)] + [(500, 1), (3, None)], "doc_id long, grade int")
    model = quality.train(df, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.score(df.withColumn("tails", F.lit(1)), model).collect()
    grade = [r.expected_grade for r in sorted(rows, key=lambda r: r.doc_id)]
    assert len(rows) == 123 and np.mean(np.array(grade[1:60:2]) > 1) > 0.9 and np.mean(np.array(grade[61:120:2]) < 1) > 0.9
    assert all(1 >= r.tails[0] >= r.tails[1] >= 0 for r in rows)
    own = df.withColumns({"tails": F.lit("own"), "expected_grade": F.lit(7), "selected": F.col("doc_id")})
    kept = quality.kept(own, model)
    assert kept.schema == own.schema and {(r.tails, r.expected_grade) for r in kept.collect()} == {("own", 7)}
    assert {r.selected for r in kept.collect()} == {r.doc_id for r in rows if r.tails[-1] >= quality.KEEP}
    assert quality.score(empty, model).count() == 0 and quality.score(docs, quality.train(empty, ratings)).count() == 13


def test_order_minhash(spark, empty, tmp_path):
    texts = [t for t in TEXTS if t is not LONG] + ["b a " * 300, "a b " * 300]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, "x y z"), (-(10**15), prose(50, 77))]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = order_minhash.op6(spark, folder).collect()
    assert len(got) == len(rows)
    order = sorted({r for r in rows if r[0] is not None}, key=lambda r: -r[0]) + [(None, "x y z")]
    by_id = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)]
        third, r = len(t) // 3, by_id[i]
        edited = t[: len(t) - third] + (following[1] or "")[:third]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1
        if t == (following[1] or ""):
            assert r.near_next == 1 and r.fingerprint == by_id[following[0]].fingerprint
    assert order_minhash.fingerprints(empty).count() == 0


def test_order_matters(spark):
    words = [f"w{k}" for k in range(200)]
    moved = words[100:] + words[:100]
    shuffled = random.Random(1).sample(words, 200)
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(moved)), (2, " ".join(shuffled)), (3, " ".join(words[:-4]))], "doc_id long, text string")
    prints = {r.doc_id: set(r.prints) for r in order_minhash.fingerprints(df).collect()}
    like = lambda a, b: len(prints[a] & prints[b]) / len(prints[a] | prints[b])
    assert like(0, 3) > 0.8 and like(0, 1) > 0.6 and like(0, 2) < 0.1


def test_embeddings_by_brute_force(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(40, 16)).astype(np.float32)
    e = np.concatenate([base, base[:20] + 0.1 * r.normal(size=(20, 16)), np.repeat(base[:1], 30, 0) + 0.05 * r.normal(size=(30, 16)), np.repeat(base[1:2], 9, 0)]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(e)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0, 2.0]]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(None, base[2].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in embeddings.near_vectors(df.repartition(4), shards=3).collect()}
    u = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    part = np.arange(len(e))
    for _ in range(len(e)):
        part = np.array([min(part[k], *part[link[k]]) if link[k].any() else part[k] for k in range(len(e))])
    for k in range(len(e)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (link[k].sum(), part[k], part[k] == k)
    for k in range(len(odd)):
        x = got[1000 + k]
        assert (x.n_links, x.component_id, x.kept) == (0, 1000 + k, True)
    assert got[None].component_id is None and embeddings.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_in_crowds(spark, kind):
    """Groups larger than a beam, with links inside and between them that hold for some members only."""
    r = np.random.default_rng(9)
    base = r.normal(size=(3, 24))
    e = np.concatenate([base[0] + 0.13 * r.normal(size=(500, 24)), base[1] + 0.2 * r.normal(size=(200, 24)), base[2] + 0.01 * r.normal(size=(150, 24)), r.normal(size=(400, 24))])
    e = e if kind == "double" else e.astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(e)], f"vec_id long, embedding array<{kind}>")
    links = embeddings.linked(df.select(F.col("vec_id").alias("id"), "embedding", F.lit(1).cast("long").alias("copies")), 0.95, 0.99, 2, 400)
    assert links.count() <= 4 * len(e)  # the pairs are over 50 000
    got = {x.vec_id: x for x in embeddings.near_vectors(df, shards=3).collect()}
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    part = np.arange(len(e))
    while (part != (new := np.minimum(part, np.where(link, part[None, :], len(e)).min(1)))).any():
        part = new
    found = sum(x.n_links for x in got.values())
    assert 0.999 * link.sum() <= found <= link.sum() and all(got[k].n_links <= link[k].sum() for k in got)
    assert [got[k].component_id for k in range(len(e))] == part.tolist()


def test_graph_recall():
    r = np.random.default_rng(4)
    v = r.normal(size=(3000, 24)).astype(np.float32)
    g = embeddings.Graph.from_bytes(embeddings.Graph.build(v).to_bytes())
    near = np.argsort(-(g.unit[:200] @ g.unit.T), 1)[:, :10]
    ids, _ = g.search(g.unit[:200], 64)
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, near, strict=True)]) > 0.9


PAGES = [
    (None, ""),
    ("", ""),
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three <b>bold</b>.<p>Be.<br>Next</article><footer>&copy; me</footer>", "A & B\nOne two three bold.\nBe.\nNext"),
    ("<article><p>Text<script>var a='</p>';</script> goes on</p><style>p{}</style><!-- no --><div class=ad>Buy</div><form><p>Mail</p></form><section id=comments><p>A reader says something long enough to be a text of its own here.</p></section></article>", "Text goes on"),
    ("<main><ul><li>first<li>second</ul></p></b><p>x &lt; y</main><aside>More</aside>", "first\nsecond\nx < y"),
    ("<article>" + "<p>word</p>" * 5000 + "</article><!-- open", "\n".join(["word"] * 5000)),
]


def test_html(spark):
    df = spark.createDataFrame([(k, "u", h, "old") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for k, (_, want) in enumerate(PAGES):
        assert (got[k].text, got[k].n_chars) == (want, len(want))
    assert html_text.extract(df.where("false")).count() == 0


SENTENCE = "one line of prose that is long enough to look like what people write when they tell a whole story"
PROSE = f"<h1>A short title</h1><p>{SENTENCE}.</p><p>Yes.</p><p>{SENTENCE}, with <a href=x>a source</a>.</p>"
PROSE_TEXT = f"A short title\n{SENTENCE}.\nYes.\n{SENTENCE}, with a source."


def test_html_without_names_that_help():
    """Words and link density of a block and its neighbours decide; the tree does ask for both."""
    menu = "<div class=a1><ul><li><a href=x>Start</a></li><li><a href=x>All of the older stories</a></li></ul></div>"
    more = f"<div class=a2><a href=x>{SENTENCE}</a></div><div class=a2><a href=x>{SENTENCE} too</a></div>"
    assert html_text.main_text(f"<body>{menu}<div class=a3>{PROSE}</div>{more}</body>") == PROSE_TEXT
    asked = {html_text.FEATURES[f] for f in html_text.tree().feature if f >= 0}
    assert {"links", "words"} <= asked and asked & {"links_before", "links_after"}


def test_html_names_are_whole_words_and_may_be_topics():
    for name in ("social-contract", "searchParty", "addendum", "formula", "adverbs"):
        page = f"<article><p class={name}>{SENTENCE}</p></article>"
        assert html_text.main_text(page) == SENTENCE, name
    for name in ("cookie-notice", "sideNav nav", "reader_comments", "promo"):
        page = f"<article>{PROSE}<div class='{name}'><p>{SENTENCE} as well</p></div></article>"
        assert html_text.main_text(page) == PROSE_TEXT, name
    share = "<div class=social><a href=x>Send on</a> <a href=x>Tell others</a></div>"
    assert html_text.main_text(f"<article>{PROSE}{share}</article>") == PROSE_TEXT


def test_html_cdata_is_a_comment():
    assert html_text.main_text("<article><p>a<![CDATA[abcdef</p>") == "a"
    assert html_text.main_text("<article><p>a<![CDATA[b]]>c</p></article>") == "ac"


def test_html_keeps_articles_of_all_lengths():
    for first in (1, 2, 7, 16, 30, 120):
        for second in (1, 3, 11, 25, 90):
            texts = [" ".join(["word"] * n) for n in (first, second)]
            page = "<nav><a href=x>Home</a></nav><article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article><footer>Imprint</footer>"
            assert html_text.main_text(page) == "\n".join(texts)


def test_html_deep_and_unclosed_pages_take_linear_time():
    """Elements left open are counted by name, so a tag never walks over all of them."""
    for part, times in (("<div>", 200_000), ("<p><font>t", 60_000), ("<div><p><font>t</div>", 40_000)):
        start = time.perf_counter()
        html_text.blocks(part * times + "x")
        assert time.perf_counter() - start < 20, part


def test_html_after_letters_that_grow_in_lower_case():
    page = "<article><p>" + "İ" * 40 + "<SCRIPT>var a;</Script> goes on</p><p>Next</p></article>"
    assert [b.text for b in html_text.blocks(page)] == ["İ" * 40 + " goes on", "Next"]


def test_urls(spark):
    given = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q", "http://example.net/EN/x", "http://x.net", "http://x.net/", "https://www.example.com/de/1", "http://notexample.com/de/1", "ftp://a.org/fr/#f", "http://a.org/frx", "http://www.bad.info/a/?x#y", "http://bad.info/a.html", "http://good.info/a://b/c", "http://bad.info/a\nb", "http://BAD.info/a/"]
    want = [("", "", None, "allow")] * 3 + [("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/EN/x", "net/", "block"), ("x.net", "", None, "allow"), ("x.net", "/", "net/", "block"), ("www.example.com", "/de/1", "example.com/de/", "block"), ("notexample.com", "/de/1", None, "allow"), ("a.org", "/fr/", "org/fr/", "allow"), ("a.org", "/frx", None, "allow"), ("www.bad.info", "/a/", None, "block"), ("bad.info", "/a.html", None, "block"), ("good.info", "/a://b/c", None, "allow"), ("bad.info", "/a\nb", None, "allow"), ("bad.info", "/a/", None, "block")]
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate(given)], "page_id long, url string, verdict int")
    listed = spark.createDataFrame([("bad.info/a",), (None,), ("bad.info/a",)], "canonical_url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, urls.RULES, listed).collect()}
    assert [got[k] for k in range(len(given))] == want
    assert urls.judge(df.where("false"), urls.RULES, listed.where("false")).count() == 0
    many = spark.range(20000).select(F.concat(F.lit("h/"), F.col("id")).alias("u"))
    even = many.where("cast(substr(u, 3) as long) % 2 = 0")
    passed = urls.possible(many, "u", urls.bloom(even, "u"))
    assert 10000 <= passed.count() < 10500 and urls.listed_keys(many, "u", even).count() == 10000


def test_pipeline_stages(spark, docs, empty, tmp_path):
    folder = str(tmp_path)
    frame(spark, [prose(60, 200 + k) for k in range(30)] + TEXTS, False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(20, 0, 0), (21, 0, 1), (22, 1, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, empty, folder).count() == 0
    rows = corpus_pipeline.run(spark, folder).collect()
    check_pieces(rows)
    assert rows
