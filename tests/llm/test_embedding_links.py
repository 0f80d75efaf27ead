"""Links of embeddings that hold only just, and what is compared for them as the table grows."""

import numpy as np

from sensorgate.llm import embeddings


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def partners(v, cosine, r):
    """Of each unit vector, one at that cosine in any direction."""
    to = r.normal(size=v.shape)
    to = unit(to - (to * v).sum(1, keepdims=True) * v)
    return cosine * v + np.sqrt(1 - cosine**2) * to


def test_links_that_hold_only_just(spark):
    """Random vectors, near to nothing else, with partners just above and just below the threshold; zeros of both signs are equal."""
    r = np.random.default_rng(6)
    v = unit(r.normal(size=(6000, 32)))
    v[:50, 3] = 0.0
    v[:50] = unit(v[:50])
    e = np.concatenate([v, partners(v[1000:3000], 0.9502, r), partners(v[3000:4000], 0.9498, r), v[:50]])
    e[-50:, 3] = -0.0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(e)], "vec_id long, embedding array<double>")
    got = {x.vec_id: x for x in embeddings.near_vectors(df).collect()}
    u = unit(e)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert link.sum() == 2 * 2050 and len(got) == len(e)
    wrong = [k for k in range(len(e)) if got[k].n_links > link[k].sum()]
    assert not wrong and sum(x.n_links for x in got.values()) >= 0.999 * link.sum()
    for a, b in zip(*np.nonzero(np.triu(link)), strict=True):
        # Both ends count a link or none does.
        assert got[a].n_links == got[b].n_links and got[b].component_id == (a if got[b].n_links else b)
    for k in range(50):
        assert (got[k].n_links, got[9000 + k].n_links, got[9000 + k].component_id) == (1, 1, k)


def test_compared_pairs_grow_with_the_vectors():
    """Comparisons and nodes for each vector at 4 000 and 64 000 vectors; the beam does not widen."""
    r = np.random.default_rng(7)
    each = []
    for n in (4_000, 64_000):
        v = unit(r.normal(size=(n, 64))).astype(np.float32)
        g = embeddings.Graph.build(v[: n // 250])
        width, below = embeddings.breadth(g, v[-1024:], 0.95, 0.999)
        held = np.bincount(embeddings.walked(g, v[-4000:], width)[:, :below].ravel(), minlength=len(g.unit)) * (n / 4000)
        assert width <= embeddings.BEAM and held.sum() == n * below
        each.append((below, (held**2).sum() / n))
    assert each[1][0] <= 10 and each[1][1] < 4 * each[0][1]  # 16 with all pairs


def test_pairs_come_once_below_their_first_common_node():
    """Whole blocks and parts of them, with runs of vectors that have met elsewhere."""
    r = np.random.default_rng(8)
    v = (r.normal(size=(1, 8)) + 0.1 * r.normal(size=(700, 8))).astype(np.float32)
    nodes = np.sort(np.argsort(r.random((700, 6)), 1)[:, :3], 1).astype(np.int32)
    nodes[:300] = [0, 2, 5]
    none = np.iinfo(np.int32).max
    nodes[300:340] = [3, none, none]  # a walk that ended at one node
    u = unit(v.astype(float))
    common = (nodes[:, None, :, None] == nodes[None, :, None, :]) & (nodes < none)[:, None, :, None]
    expected = {(a, b) for a, b in zip(*np.nonzero(np.triu((u @ u.T >= 0.95) & common.any((2, 3)), 1)), strict=True)}
    for blocks in (1, 3):
        found = []
        for node in range(6):
            held = np.flatnonzero((nodes == node).any(1))
            for i in range(blocks):
                for j in range(i, blocks):
                    sides = [x[np.argsort(nodes[x, 0], kind="stable")] for x in ([held[held % blocks == i]] if i == j else [held[held % blocks == k] for k in (i, j)])]
                    at = np.concatenate(sides)
                    for a, b in embeddings.near_pairs(v[at], nodes[at], node, 0.95, None if i == j else len(sides[0])):
                        found += [tuple(sorted(x)) for x in zip(at[a], at[b], strict=True)]
        assert len(found) == len(set(found)) and set(found) == expected


def test_tables_where_nodes_say_little_are_compared_whole(spark):
    """All vectors are so near to one direction that few nodes stay apart, and a vector would hang below most of them."""
    r = np.random.default_rng(9)
    e = np.ones((3000, 128)) + 0.36 * r.normal(size=(3000, 128))
    e[2000:2500] = e[:500] + 0.2 * r.normal(size=(500, 128))
    top = e[500:532]
    assert embeddings.breadth(embeddings.Graph.build(top[embeddings.thinned(top, 0.9)]), e[900:1924], 0.95, 0.999)[1] == 0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(e)], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.n_links for x in embeddings.near_vectors(df, most=700).collect()}
    link = unit(e) @ unit(e).T >= 0.95
    np.fill_diagonal(link, False)
    assert link.sum() == 1000 and [got[k] for k in range(len(e))] == link.sum(1).tolist()
