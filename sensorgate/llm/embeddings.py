"""Near duplicates of embeddings by a hierarchical navigable small-world graph.

Equal vectors are joined first, so a group of copies is one vector with a count. The graph (layers of ever fewer nodes,
every node linked to near ones in different directions) stands over a sample of the distinct vectors, one for about
``BELOW`` of them, from which nodes that are too near to another one are left out; it is kept as a file in the shared
folder. Every vector walks the graph, down the upper layers and with a beam on the ground layer, and hangs below the first
few nodes of its beam. Vectors that hang below the same node are compared with each other, and pairs are kept if their
cosine, in double precision on the given numbers, reaches the threshold; links count copies, and components are the
unions of links.

How many nodes a vector hangs below is audited, not assumed: up to ``AUDITED`` vectors that are no nodes get a partner of
exactly the threshold, half of them towards any direction and half towards another vector of the table, both walk, and the
number (and the beam, if need be) grows until a share ``recall`` of the partners meet below a node; then one node is added.
Pairs above the threshold meet more often than these. Where so many nodes are needed that all pairs of vectors would be fewer,
the graph is left with one node, and all vectors are compared.

What is compared grows with the vectors: nodes grow with them up to ``NODES`` (beyond that, shards do). A pair is compared
below its first common node only; nodes are numbered by what hangs below them, the fullest first, so a large group of
near copies is compared once. What hangs below a node is dealt out in blocks, and a task takes two blocks of a bounded number
of vectors. Pairs do not leave it: it gives back the number of links of each vector and a spanning forest. Within a large
group the comparisons still grow with its square, as exact numbers of links need them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing and are components
of their own; vectors of different lengths never link; rows that share an id and a vector count as copies, and an id with
several vectors has the links of all of them; a row without an id links with nothing and has no component; an empty table
gives no row; other columns are ignored. Arrays of doubles are compared as given, all others as floats.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm.common import query, stored, table
from sensorgate.llm.components import components
from sensorgate.llm.token_files import filesystem
from sensorgate.session import scratch_path

LINKS = 16  # of a node in an upper layer; twice as many in the ground layer
BUILD_BEAM = 64
BEAM = 32
BELOW = 512  # vectors for a node of the graph
NODES = 1 << 14  # of a graph, which one task builds
AUDITED = 1024  # vectors whose partners are sought
AT_ONCE = 512  # queries of a walk
ROWS = 128  # of a block of exact comparisons, which has at most ``CELLS`` pairs
CELLS = 1 << 22
BLOCKS = 32  # of a node, while they stay below ``LARGE``
LARGE = 1 << 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled by the largest number first: the squares of very large or small numbers leave the range of doubles."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """Layers of links over unit vectors; all steps work on batches of queries."""

    def __init__(self, vectors: np.ndarray):
        self.raw = np.ascontiguousarray(vectors)
        self.unit = unit(self.raw)
        self.layers: list[np.ndarray] = []
        self.entry = 0

    # Search

    def beam(self, layer: int, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest found for each query, nearest first: ids (-1: none) and cosines. ``entries``: ids per query."""
        links, count, n = self.layers[layer], len(q), len(self.unit)
        ids, near = np.full((count, width), -1, np.int32), np.full((count, width), -np.inf, np.float32)
        open_, seen = np.zeros((count, width), bool), np.zeros((count, n), bool)
        rows = np.arange(count)

        def add(who: np.ndarray, found: np.ndarray) -> None:
            """Merge found ids (-1: none) of the queries ``who`` in their beams."""
            found = np.sort(found, 1)
            new = found >= 0
            new[:, 1:] &= found[:, 1:] != found[:, :-1]
            new &= ~seen[who[:, None], found]
            a, b = np.nonzero(new)
            seen[who[a], found[a, b]] = True
            value = np.full(found.shape, -np.inf, np.float32)
            value[a, b] = np.einsum("ij,ij->i", q[who[a]], self.unit[found[a, b]])
            all_ids = np.concatenate([ids[who], found], 1)
            all_near = np.concatenate([near[who], value], 1)
            all_open = np.concatenate([open_[who], new], 1)
            top = np.argsort(-all_near, 1, kind="stable")[:, :width]
            ids[who], near[who], open_[who] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_near, all_open))

        add(rows, entries.astype(np.int32))
        at_once = 4 if width > 4 else 1
        while True:
            open_ &= near > -np.inf
            who = np.flatnonzero(open_.any(1))
            if not len(who):
                return ids, near
            order = np.argsort(~open_[who], 1, kind="stable")[:, :at_once]  # the nearest open ones come first
            chosen = np.take_along_axis(ids[who], order, 1)
            valid = np.take_along_axis(open_[who], order, 1)
            open_[who[:, None], order] = False
            found = links[np.where(valid, chosen, 0)]
            add(who, np.where(valid[:, :, None], found, -1).reshape(len(who), -1))

    def down(self, q: np.ndarray, to: int) -> np.ndarray:
        """Entries of each query for layer ``to``."""
        at = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, to, -1):
            at = self.beam(layer, q, at, 1)[0]
        return at

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self.beam(0, q, self.down(q, 0), width)

    # Building

    def choose(self, own: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
        """Links of vectors out of candidates (-1: none): those nearer to the vector than to a link chosen before, then the nearest of the rest."""
        out = np.full((len(own), most), -1, np.int32)
        for at in range(0, len(own), 1024):
            who, cand = own[at : at + 1024], np.sort(found[at : at + 1024], 1)
            fresh = (cand >= 0) & (cand != who[:, None])
            fresh[:, 1:] &= cand[:, 1:] != cand[:, :-1]
            near = np.where(fresh, np.einsum("id,ijd->ij", self.unit[who], self.unit[cand]), -np.inf)
            order = np.argsort(-near, 1, kind="stable")
            cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
            among = self.unit[cand] @ self.unit[cand].transpose(0, 2, 1)
            closest, chosen = np.full(cand.shape, -np.inf, np.float32), np.zeros(cand.shape, bool)
            taken = np.zeros(len(who), int)
            for j in range(cand.shape[1]):
                take = (near[:, j] > closest[:, j]) & (taken < most // 2) & np.isfinite(near[:, j])
                chosen[:, j] = take
                taken += take
                closest = np.where(take[:, None], np.maximum(closest, among[:, j]), closest)
            # Chosen ones first, then by nearness.
            order = np.argsort(~chosen, 1, kind="stable")[:, :most]
            picked = np.where(np.isfinite(np.take_along_axis(near, order, 1)), np.take_along_axis(cand, order, 1), -1)
            out[at : at + 1024, : picked.shape[1]] = picked
        return out

    def insert(self, layer: int, new: np.ndarray, found: np.ndarray) -> None:
        links = self.layers[layer]
        most = links.shape[1]
        mutual = np.full((len(new), min(len(new) - 1, BUILD_BEAM)), -1, np.int32)
        if mutual.shape[1]:
            among = self.unit[new] @ self.unit[new].T
            np.fill_diagonal(among, -np.inf)
            mutual = new[np.argsort(-among, 1, kind="stable")[:, : mutual.shape[1]]].astype(np.int32)
        links[new] = self.choose(new, np.concatenate([found, mutual], 1), most)
        # The other direction: every linked vector chooses anew among its links and the new ones.
        a, b = np.nonzero(links[new] >= 0)
        to, source = links[new][a, b], new[a]
        order = np.lexsort((source, to))
        to, source = to[order], source[order]
        changed, first, size = np.unique(to, return_index=True, return_counts=True)
        for limit in range(0, int(size.max(initial=0)), most):
            part = size > limit
            who, begin, length = changed[part], first[part] + limit, np.minimum(size[part] - limit, most)
            extra = np.full((len(who), most), -1, np.int32)
            column = np.arange(most)
            fill = column[None, :] < length[:, None]
            extra[fill] = source[(begin[:, None] + column)[fill]]
            links[who] = self.choose(who, np.concatenate([links[who], extra], 1), most)

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        g, n = cls(vectors), len(vectors)
        rng = np.random.default_rng(n)
        order = rng.permutation(n)
        level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
        g.entry = int(order[0])
        top = int(level.max(initial=0))
        level[g.entry] = top
        g.layers = [np.full((n, LINKS * (1 if k else 2)), -1, np.int32) for k in range(top + 1)]
        at = 1
        while at < n:
            new = order[at : at + min(at, 512)]
            entries = np.full((len(new), 1), g.entry, np.int32)
            for layer in range(top, -1, -1):
                part = level[new] >= layer
                if part.any():
                    found, _ = g.beam(layer, g.unit[new[part]], entries[part], BUILD_BEAM)
                    entries[part] = found[:, :1]
                    g.insert(layer, new[part], found)
                if layer and not part.all():
                    entries[~part] = g.beam(layer, g.unit[new[~part]], entries[~part], 1)[0]
            at += len(new)
        return g

    # Files

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, raw=self.raw, entry=self.entry, **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        held = np.load(io.BytesIO(data))
        g = cls(held["raw"])
        g.entry = int(held["entry"])
        g.layers = [held[f"layer{k}"] for k in range(sum(n.startswith("layer") for n in held.files))]
        return g


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows in pairs, in double precision."""
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a.astype(np.float64), b.astype(np.float64)))
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def thinned(vectors: np.ndarray, cosine: float) -> np.ndarray:
    """Positions of vectors in their order, without those that are as near as ``cosine`` to one that stays."""
    v = unit(vectors)
    stays = np.ones(len(v), bool)
    for k in range(len(v)):
        if stays[k]:
            stays[k + 1 :] &= v[k + 1 :] @ v[k] < cosine
    return np.flatnonzero(stays)


def walked(g: Graph, q: np.ndarray, width: int) -> np.ndarray:
    """Nodes at which unit vectors end, nearest first (-1: none)."""
    return np.concatenate([g.search(q[at : at + AT_ONCE], width)[0] for at in range(0, len(q), AT_ONCE)])


def breadth(g: Graph, sample: np.ndarray, threshold: float, recall: float) -> tuple[int, int]:
    """Width of the beam, and number of nodes to hang below so that partners of ``sample`` at the threshold meet; 0: too many."""
    n, count = len(g.unit), len(sample)
    if count < 64:  # too few to judge by
        return n, n
    x, rng = unit(sample), np.random.default_rng(count)
    to = np.where((np.arange(count) % 2 == 0)[:, None], rng.standard_normal(x.shape), np.roll(x, 1, 0))
    to -= np.einsum("ij,ij->i", to, x)[:, None] * x
    to /= np.maximum(np.linalg.norm(to, axis=1, keepdims=True), 1e-9)
    partners = unit(threshold * x + np.sqrt(max(0, 1 - threshold**2)) * to)
    width = min(BEAM, n)
    while True:
        meet = np.zeros(count, int)
        for at in range(0, count, AT_ONCE):
            a, b = (g.search(q[at : at + AT_ONCE], width)[0] for q in (x, partners))
            place = np.full((len(b), n + 1), n, np.int32)  # the last column is that of no node
            place[np.arange(len(b))[:, None], b] = np.arange(width)
            place[:, n] = n
            meet[at : at + AT_ONCE] = np.maximum(np.take_along_axis(place, a % (n + 1), 1), np.arange(width)).min(1)
        below = int(np.sort(meet)[int(np.ceil(recall * count)) - 1]) + 2
        if below <= width or width == n:
            return width, min(below, n) if below**2 <= 2 * n else 0
        if width**2 > 2 * n:
            return width, 0
        width = min(2 * width, n)


def near_pairs(vectors: np.ndarray, nodes: np.ndarray, node: int, threshold: float, left: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that reach the threshold and have ``node`` as their first common one, in blocks.

    ``nodes`` are those of each vector in ascending order; vectors are sorted by their first one. With ``left``, so many vectors
    are compared with the rest (both parts sorted), else all with each other; every pair comes once.
    """
    v, n, first = unit(vectors), len(vectors), nodes[:, 0]
    margin = max(1e-5, (vectors.shape[1] + 4) * 2.0**-23)  # more than the error of a product of unit vectors of floats
    slack, sure = threshold - margin, threshold + margin
    before, other = np.where(nodes < node, nodes, -1), np.where(nodes < node, nodes, -2)
    start = 0 if left is None else left
    rows = max(1, min(ROWS, CELLS // max(1, n - start)))
    for at in range(0, n if left is None else left, rows):
        end = min(at + rows, n if left is None else left)
        begin = at if left is None else left
        parts = [(begin, n)]
        if first[at] == first[end - 1] != node:  # these have met the others of that first node there
            parts = [(begin, begin + np.searchsorted(first[begin:], first[at])), (begin + np.searchsorted(first[begin:], first[at], "right"), n)]
        for low, high in parts:
            near = (v[at:end] @ v[low:high].T).ravel()
            hits = np.flatnonzero(near >= slack)
            if not len(hits):
                continue
            a, b = np.divmod(hits, high - low)
            a, b, near = a + at, b + low, near[hits]
            good = (a < b) & ((first[a] == node) | (first[b] == node))
            unsure = np.flatnonzero((a < b) & ~good)
            for k in range(0, len(unsure), 1 << 15):
                part = unsure[k : k + (1 << 15)]
                good[part] = ~(before[a[part]][:, :, None] == other[b[part]][:, None, :]).any((1, 2))
            close = np.flatnonzero(good & (near < sure))
            for k in range(0, len(close), 1 << 15):
                part = close[k : k + (1 << 15)]
                good[part] = cosines(vectors[a[part]], vectors[b[part]]) >= threshold
            yield a[good], b[good]


class Forest:
    """Spanning forest of links between ``n`` vertices that come in blocks."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of the links that join trees. Roots are the smallest vertices of their trees."""
        at, used = np.arange(len(a)), []
        while True:
            ra, rb = self.root[a[at]], self.root[b[at]]
            apart = ra != rb
            at, ra, rb = at[apart], ra[apart], rb[apart]
            if not len(at):
                return np.concatenate(used) if used else at
            moved, first = np.unique(np.maximum(ra, rb), return_index=True)
            self.root[moved] = np.minimum(ra, rb)[first]  # each root once, to a smaller one: no circles
            used.append(at[first])
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def _write(folder: str, name: str, g: Graph) -> None:
    where, path = filesystem(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{name}") as f:
        f.write(g.to_bytes())


def _read(folder: str, name: str) -> Graph:
    where, path = filesystem(folder)
    with where.open_input_file(f"{path}/{name}") as f:
        return Graph.from_bytes(f.read())


def _packed(rows: np.ndarray) -> pa.Array:
    """Bytes of each row of numbers."""
    wide = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, len(rows) * wide + 1, wide).astype(np.int32) if len(rows) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _numbers(packed: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), -1)


def usable(embedding: str = "embedding"):
    """Not null, not empty, not zero, all numbers finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(embedding).isNotNull() & fine & F.exists(embedding, lambda x: x != 0)


def grown(distinct: DataFrame, threshold: float, recall: float, shards: int, folder: str) -> dict[int, tuple[str, int, int, int]]:
    """Graphs over samples of ``distinct``: for each length of vectors file, nodes, width of the beam, nodes to hang below."""
    counts = {r["dims"]: r["count"] for r in distinct.groupBy("dims").count().collect()}
    if not counts:
        return {}
    nodes = {d: min(max(n // BELOW, shards), NODES, n) for d, n in counts.items()}
    limit = F.create_map(*(F.lit(x) for d, n in counts.items() for x in (d, min(1.0, 1.1 * (nodes[d] + AUDITED) / n))))
    sample = distinct.select("dims", "embedding", "id", (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) / (1 << 30)).alias("at")).where(F.col("at") < limit[F.col("dims")])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, dims = pdf.sort_values(["at", "id"], kind="stable"), int(pdf["dims"].iloc[0])
        vectors = np.stack(list(pdf["embedding"]))
        top = vectors[: nodes[dims]]
        g = Graph.build(top[thinned(top, 2 * threshold - 1)])
        width, below = breadth(g, vectors[len(top) :][:AUDITED], threshold, recall)
        if not below:  # it takes less to compare all vectors
            g, width, below = Graph.build(top[:1]), 1, 1
        name = f"graph-{dims}-{TaskContext.get().taskAttemptId()}.bin"
        _write(folder, name, g)
        return pd.DataFrame({"dims": [dims], "file": [name], "nodes": [len(g.unit)], "width": [width], "below": [below]})

    built = sample.groupBy("dims").applyInPandas(build, "dims int, file string, nodes int, width int, below int")
    return {r["dims"]: (r["file"], r["nodes"], r["width"], r["below"]) for r in stored(built, "graph_files").collect()}


def linked(distinct: DataFrame, threshold: float, recall: float, shards: int, most: int) -> DataFrame:
    """Links of ``distinct`` (``id, embedding, copies``) as rows ``id, links, other``.

    ``links`` are to be summed over the rows of an id (copies of other ids); rows that have ``other`` are edges of a forest.
    """
    spark, folder = distinct.sparkSession, scratch_path(distinct.sparkSession, "graphs")
    kind = np.float64 if distinct.schema["embedding"].dataType.elementType.typeName() == "double" else np.float32
    graphs = grown(distinct.withColumn("dims", F.size("embedding")), threshold, recall, shards, folder)
    if not graphs:
        return spark.createDataFrame([], "id long, links long, other long")
    offset = dict(zip(graphs, np.cumsum([0, *(x[1] for x in graphs.values())]).tolist()))  # nodes are numbered over all graphs
    none, most_nodes = np.iinfo(np.int32).max, max(x[3] for x in graphs.values())

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            lengths = pc.list_value_length(batch["embedding"]).to_numpy()
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                file, _, width, below = graphs[dims]
                if dims not in held:
                    held = {dims: _read(folder, file)}
                vectors = part["embedding"].flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
                at = walked(held[dims], unit(vectors), width)[:, :below]
                sizes = (at >= 0).sum(1)
                ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                nodes = pa.ListArray.from_arrays(ends, pa.array((at[at >= 0] + offset[dims]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part["id"], part["copies"], _packed(vectors), nodes], ["id", "copies", "vector", "nodes"])

    count = distinct.count()
    spread = distinct.select("id", "copies", "embedding").repartition(-(-count // 4096), "id")
    hung = stored(spread.mapInArrow(hang, "id long, copies long, vector binary, nodes array<int>"), "hung")

    # The fullest nodes come first; a node's vectors are dealt out in blocks.
    full = sorted(((r["count"], r["node"]) for r in hung.select(F.explode("nodes").alias("node")).groupBy("node").count().collect()), key=lambda x: (-x[0], x[1]))
    number = np.full(sum(x[1] for x in graphs.values()), none, np.int32)
    number[[x[1] for x in full]] = np.arange(len(full))
    blocks = np.array([max(1, min(n // most, BLOCKS), -(-n // LARGE)) for n, _ in full])
    rows = int(sum(n * k for (n, _), k in zip(full, blocks.tolist(), strict=True)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch["id"].to_numpy(), pc.list_value_length(batch["nodes"]).to_numpy()
            owner = np.repeat(np.arange(len(ids)), sizes)
            node = number[batch["nodes"].flatten().to_numpy()]
            own = np.full((len(ids), most_nodes), none, np.int32)
            own[np.arange(own.shape[1]) < sizes[:, None]] = node
            own = np.sort(own, 1)
            sorted_nodes = _packed(own)
            k = blocks[node]
            mixed = (ids[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            mine = (mixed % k.astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(owner)), k)
            theirs = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
            for begin in range(0, len(at), 1 << 14):
                part, with_ = at[begin : begin + (1 << 14)], theirs[begin : begin + (1 << 14)]
                a, b, who = np.minimum(mine[part], with_), np.maximum(mine[part], with_), pa.array(owner[part])
                columns = [pa.array(node[part]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(mine[part] != a)]
                columns += [batch["id"].take(who), batch["copies"].take(who), batch["vector"].take(who), sorted_nodes.take(who)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "a", "b", "right", "id", "copies", "vector", "nodes"])

    def compare(t: pa.Table) -> pa.Table:
        node, whole = t["node"][0].as_py(), t["a"][0].as_py() == t["b"][0].as_py()
        nodes, right = _numbers(t["nodes"], np.int32), t["right"].to_numpy()
        order = np.lexsort((t["id"].to_numpy(), nodes[:, 0], right))
        ids, copies, nodes = t["id"].to_numpy()[order], t["copies"].to_numpy()[order], nodes[order]
        vectors, n = _numbers(t["vector"], kind)[order], len(order)
        links, forest, edges = np.zeros(n, np.int64), Forest(n), [np.zeros((2, 0), np.int64)]
        for a, b in near_pairs(vectors, nodes, node, threshold, None if whole else int((~right).sum())):
            different = ids[a] != ids[b]
            a, b = a[different], b[different]
            links += (np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)).astype(np.int64)
            used = forest.add(a, b)
            edges.append(np.stack([ids[a[used]], ids[b[used]]]))
        some, (u, v) = np.flatnonzero(links), np.concatenate(edges, 1)
        other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(v)])
        return pa.table({"id": np.append(ids[some], u), "links": np.append(links[some], np.zeros(len(u), np.int64)), "other": other})

    kinds = "node int, a int, b int, right boolean, id long, copies long, vector binary, nodes binary"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (1 << 15)))
    dealt = hung.mapInArrow(deal, kinds).repartition(parts, "node", "a", "b")
    found = dealt.groupBy("node", "a", "b").applyInArrow(compare, "id long, links long, other long")
    return found.groupBy("id", "other").agg(F.sum("links").alias("links")).select("id", "links", "other")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, shards: int = 32, most: int = 8192) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (vec_id, embedding)."""
    wide = vectors.schema["embedding"].dataType.elementType.typeName() == "double"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    rows = rows.withColumn("hash", F.xxhash64("embedding"))  # joins sort by a number instead of arrays
    valid = rows.where(usable() & F.col("vec_id").isNotNull())
    groups = stored(valid.groupBy("hash", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "distinct_vectors")
    links = stored(linked(groups, threshold, recall, shards, most), "links")
    sizes = groups.groupBy("id").agg(F.sum("copies").alias("copies"))
    outside = links.groupBy("id").agg(F.sum("links").alias("outside"))
    parts = components(links.where("other is not null"), "id", "other")
    known = sizes.join(outside, "id", "left").join(parts, "id", "left").select("id", (F.coalesce("outside", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    owner = valid.join(groups.select("hash", "embedding", "id"), ["hash", "embedding"]).select("vec_id", "id").join(known, "id").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~F.coalesce(usable() & F.col("vec_id").isNotNull(), F.lit(False)))
    out = owner.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@query("op3_embeddings")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))
