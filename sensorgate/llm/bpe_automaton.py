"""BPE as a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that merging would give. It starts with one state and a loop for every
base symbol. Each merge ``u v -> uv``, in order of rank, is built in as a gadget: what follows a ``u`` gets a state of its
own, from which ``v`` no longer leaves; the new label ``uv`` starts wherever ``u`` started and ends where ``v`` ended. If
u = v the new label does not leave that state either, because pairs are merged from the left. All states accept. Labels
that every state treats alike share a column, so the table has a row for each state and a column for each label class,
and one bit for "no arc". Its size depends on the vocabulary alone.

Encoding a word walks over its symbols. Every prefix of a word has exactly one accepted token sequence, so each position
holds one state, and the token that ends there is the one label whose start position has an arc for it. Words of a batch
are walked together: a trie step finds the labels that start at a position, a table look-up tells whether the arc is
there. Decoding emits the labels of the arcs.

Words that are seen often are kept in a bounded cache per Python worker.

Defined cases: a null or empty text has no token; words that hold a symbol outside the vocabulary raise an error (the
byte alphabet is complete in the vocabularies used); equal texts give equal rows; an empty table gives no row; texts of
any length are walked word by word; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm.common import WORD_VOCAB, query, table
from sensorgate.llm.words import _CASES, SHORT, PieceCache, byte_symbols, is_normalized, slices, space_pieces


class Bits:
    """A bit matrix that grows by copies of rows and columns."""

    def __init__(self):
        self.rows = self.columns = 1
        self.data = np.zeros((1024, 128), np.uint8)

    def copy_row(self, i: int) -> int:
        if self.rows == len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.rows] = self.data[i]
        self.rows += 1
        return self.rows - 1

    def copy_column(self, j: int) -> int:
        if self.columns == 8 * self.data.shape[1]:
            self.data = np.concatenate([self.data, np.zeros_like(self.data)], 1)
        to = self.columns
        bit = self.data[: self.rows, j >> 3] >> (7 - (j & 7)) & 1
        self.data[: self.rows, to >> 3] |= bit << (7 - (to & 7))
        self.columns += 1
        return to

    def set(self, i: int, j: int) -> None:
        self.data[i, j >> 3] |= 128 >> (j & 7)

    def used(self) -> np.ndarray:
        return np.ascontiguousarray(self.data[: self.rows, : (self.columns + 7) // 8])


@dataclass
class Automaton:
    labels: list[str]  # by id
    state: np.ndarray  # of each label's arcs: the state they lead to
    column: np.ndarray  # of each label: its class
    missing: np.ndarray  # bit per state and class: no arc
    root: int  # state before the first token: the start state, from which all labels leave
    symbols: dict[str, int]
    edges: np.ndarray  # trie: sorted (node << 16 | symbol)
    targets: np.ndarray  # node behind each edge
    near: np.ndarray  # the same for the nodes of the first two levels, by node and symbol; -1: no edge
    token: np.ndarray  # id of the label that ends at a node, or -1


def compile_merges(vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> Automaton:
    """Successive gadgets, then the trie of all labels. ``suffix`` ends the last symbol of a word."""
    size = max(vocabulary.values()) + 1
    labels: list[str] = [""] * size
    for word, i in vocabulary.items():
        labels[i] = word
    state, column = np.zeros(size, np.int32), np.zeros(size, np.int32)
    bits, made = Bits(), {b for a in merges for b in (a[0] + a[1],)}
    on_state = {0: {vocabulary[w] for w in vocabulary if w not in made}}
    on_column = {0: set(on_state[0])}

    def own(of: np.ndarray, groups: dict[int, set[int]], label: int, copy) -> int:
        """The label's state (or class), split off if others share it."""
        g = int(of[label])
        if len(groups[g]) > 1 or (g == 0 and of is state):  # state 0 stays the start
            groups[g].discard(label)
            g = of[label] = copy(g)
            groups[int(g)] = {label}
        return int(g)

    for left, right in merges:
        u, v, new = vocabulary[left], vocabulary[right], vocabulary[left + right]
        state[new], column[new] = state[v], column[u]
        on_state[int(state[v])].add(new)
        on_column[int(column[u])].add(new)
        row = own(state, on_state, u, bits.copy_row)
        bits.set(row, own(column, on_column, v, bits.copy_column))
        if u == v:
            bits.set(row, own(column, on_column, new, bits.copy_column))
    chains = [([*w.removesuffix(suffix)[:-1], w.removesuffix(suffix)[-1] + suffix] if suffix and w.endswith(suffix) else [*w]) for w in labels]
    symbols = {s: k for k, s in enumerate(sorted({s for c in chains for s in c}))}
    nodes: dict[tuple[int, int], int] = {}
    token = [-1]
    for i, chain in [*((-1, c[:1]) for c in chains), *enumerate(chains)]:  # nodes of the first level get the first numbers
        at = 0
        for s in chain:
            step = (at, symbols[s])
            if step not in nodes:
                nodes[step] = len(token)
                token.append(-1)
            at = nodes[step]
        if i >= 0:
            token[at] = i
    edges = np.array([a << 16 | s for a, s in nodes], np.int64)
    order = np.argsort(edges)
    targets = np.array(list(nodes.values()), np.int32)[order]
    near = np.full((1 + len({c[0] for c in chains if c}), len(symbols)), -1, np.int32)
    for (a, s), b in nodes.items():
        if a < len(near):
            near[a, s] = b
    return Automaton(labels, state, column, bits.used(), 0, symbols, edges[order], targets, near, np.array(token, np.int32))


def walk(a: Automaton, words: list[list[int]]) -> list[list[int]]:
    """Ids of words given as symbol numbers; all words of a length are walked together."""
    out: list[list[int]] = [[]] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, members in by_length.items():
        for at in range(0, len(members), max(1, 400_000 // max(n, 1))):
            own = members[at : at + max(1, 400_000 // max(n, 1))]
            for i, ids in zip(own, _walk_equal(a, np.array([words[i] for i in own], np.int64).reshape(len(own), n)), strict=True):
                out[i] = ids
    return out


def _walk_equal(a: Automaton, symbols: np.ndarray) -> list[list[int]]:
    count, n = symbols.shape
    state = np.full((n + 1, count), -1, np.int32)  # after the prefix of each length
    begin = np.full((n + 1, count), -1, np.int32)  # where its last token starts
    label = np.full((n + 1, count), -1, np.int32)
    state[0] = a.root
    for i in range(n):
        alive, node, here = np.arange(count), np.zeros(count, np.int64), state[i]
        for j in range(i, n):
            if j < i + 2:
                to = a.near[node, symbols[alive, j]]
                on = to >= 0
                alive, node = alive[on], to[on].astype(np.int64)
            else:
                key = node << 16 | symbols[alive, j]
                edge = np.minimum(np.searchsorted(a.edges, key), len(a.edges) - 1)
                on = a.edges[edge] == key
                alive, node = alive[on], a.targets[edge[on]].astype(np.int64)
            if not len(alive):
                break
            found = a.token[node]
            is_label = found >= 0
            who, found = alive[is_label], found[is_label]
            row, col = here[who], a.column[found]
            arc = (a.missing[row, col >> 3] >> (7 - (col & 7)) & 1) == 0
            who, found = who[arc], found[arc]
            state[j + 1, who], begin[j + 1, who], label[j + 1, who] = a.state[found], i, found
    if n and (label[1:] < 0).any():
        raise ValueError("a symbol is not in the vocabulary")
    out: list[list[int]] = [[] for _ in range(count)]
    ids, starts = label.T.tolist(), begin.T.tolist()
    for ids_of, start_of, own in zip(ids, starts, out, strict=True):
        j = n
        while j:
            own.append(ids_of[j])
            j = start_of[j]
        own.reverse()
    return out


class WordTokenizer:
    """A vocabulary file with word ends: normalising, splitting, the automaton, and decoding by labels."""

    #: Fixed value: the split pattern of the vocabulary file.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, automaton: Automaton | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.automaton = automaton or compile_merges(model["vocab"], [tuple(m) for m in model["merges"]], self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.labels = dict(enumerate(self.automaton.labels)) | {i: s for s, i in self.special.items()}
        symbols, bytes_ = self.automaton.symbols, byte_symbols()
        self.inner = [symbols.get(c, -1) for c in bytes_]
        self.final = [symbols.get(c + self.suffix, -1) for c in bytes_]
        self.cache = PieceCache(self._encode, 150_000)
        self.library = None
        self.path = path
        self.cores: dict[str, tuple[int, str, str]] = {}
        self.ends = {c: self._spelled([c])[0] for c in ".,"}

    def _split(self, piece: str) -> list[str]:
        """Words of a piece without white space, after normalising."""
        if piece.isascii():
            return self.PATTERN.findall(piece.lower())
        if piece.isalpha() and _CASES.isdisjoint(piece) and is_normalized("NFC", piece):
            return [piece.lower()]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(piece)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _spelled(self, words: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids in decimal and labels of normalised words."""
        inner, final, labels = self.inner, self.final, self.labels
        coded = [[*[inner[b] for b in w[:-1]], final[w[-1]]] for w in map(str.encode, words)]
        return [(len(i), " ".join(map(str, i)), " ".join([labels[k] for k in i])) for i in walk(self.automaton, coded)]

    def _encode(self, pieces: list[str]) -> list[tuple[int, str, str]]:
        """Most pieces are one word of letters with at most a full stop or comma after it."""
        cores, plain, others, ends = self.cores, [], [], self.ends
        if len(cores) > self.cache.most:
            cores.clear()
        for i, p in enumerate(pieces):
            core = p[:-1] if p[-1] in ends else p
            if core.isalpha() and (core.isascii() or _CASES.isdisjoint(core) and is_normalized("NFC", core)):
                plain.append((i, core.lower(), p[-1] if len(core) < len(p) else ""))
            else:
                others.append(i)
        missing = list({core for _, core, _ in plain}.difference(cores))
        cores.update(zip(missing, self._spelled(missing), strict=True))
        passing = [w for w in missing if len(w) > SHORT]
        out: list = [None] * len(pieces)
        for i, core, end in plain:
            n, ids, text = cores[core]
            if end:
                one, more_ids, more_text = ends[end]
                out[i] = (n + one, f"{ids} {more_ids}", f"{text} {more_text}")
            else:
                out[i] = cores[core]
        for i, found in zip(others, self._any([pieces[i] for i in others]), strict=True):
            out[i] = found
        for w in passing:
            del cores[w]
        return out

    def _any(self, pieces: list[str]) -> list[tuple[int, str, str]]:
        words: dict[str, int] = {}
        plan: list[list[int]] = []
        for p in pieces:
            own: list[int] = []
            for part in self.special_pattern.split(p) if "<|" in p else [p]:
                if part in self.special:
                    own.append(-1 - self.special[part])
                else:
                    own += [words.setdefault(w, len(words)) for w in self._split(part) if w]
            plan.append(own)
        made = self._spelled(list(words))
        special = {-1 - i: (1, str(i), s) for s, i in self.special.items()}
        rows = [[made[k] if k >= 0 else special[k] for k in own] for own in plan]
        return [(sum(x[0] for x in r), " ".join([x[1] for x in r]), " ".join([x[2] for x in r])) for r in rows]

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, ids in decimal, decoded text; both joined by a space."""
        pieces = [space_pieces(t) for t in texts]
        known = self.cache(pieces)
        for own in pieces:
            if own:
                counts, ids, decoded = zip(*map(known.__getitem__, own), strict=True)
                yield sum(counts), " ".join(ids), " ".join(decoded)
            else:
                yield 0, "", ""


def pack_automaton(a: Automaton) -> dict:
    """For sending to executors: the table is mostly zeros."""
    return a.__dict__ | {"missing": (zlib.compress(a.missing.tobytes(), 1), a.missing.shape)}


def unpack_automaton(d: dict) -> Automaton:
    data, shape = d["missing"]
    return Automaton(**d | {"missing": np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape)})


_HELD: dict[str, WordTokenizer] = {}


def held_tokenizer(vocabulary: str, sent) -> WordTokenizer:
    """One for all tasks of a Python worker, made from the broadcast automaton."""
    if vocabulary not in _HELD:
        _HELD[vocabulary] = WordTokenizer(vocabulary, unpack_automaton(sent.value))
    return _HELD[vocabulary]


SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"


def round_trip(docs: DataFrame, vocabulary: str = WORD_VOCAB, hashed: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of ``doc_id, text``; ids in decimal. ``hashed``: sha256 in place of both texts."""
    automaton = docs.sparkSession.sparkContext.broadcast(pack_automaton(WordTokenizer(vocabulary).automaton))
    schema = SCHEMA if not hashed else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    arrow = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in schema.split(", ")])
    show = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if hashed else (lambda s: s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = held_tokenizer(vocabulary, automaton)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                rows = [(k, n, show(ids), show(text)) for k, (n, ids, text) in zip(keys[a:b], tokenizer(texts[a:b]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


@query("op10_bpe_automaton")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), WORD_VOCAB, hashed=True)
