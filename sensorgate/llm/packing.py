"""Vector bin packing of examples into training sequences.

Every example has three demands: tokens, one segment and loss-bearing tokens; a sequence has a limit on each. Examples
longer than a sequence are cut in whole sequences first; what remains is packed by the dot-product heuristic: the open
sequence takes the example whose demand vector, scaled by the limits, has the largest dot product with the room that
is left. Then sequences far from full are dissolved and their examples, cut where need be, fill the room that is left in
others. The last sequence of a block is cut at powers of two, so that every sequence has 2048 tokens or a power of two.

A task packs the rows of its partition in blocks of bounded size; there is no shuffle. Sequence ids are the partition
number times 2**32 plus a counter, so a repeated task gives the same rows.

Defined cases: a null text is an empty one; an example without tokens (possible only without an end id) gets a piece of
length 0 in a sequence of its own kind, none; equal rows are packed each on its own; an empty table gives no row; other
columns are ignored. A piece keeps ``start`` so that the ids of an example can be put together again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm.common import BYTE_VOCAB, crc32, query, table
from sensorgate.llm.words import encoder, slices


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    block: int = 4096  # examples packed together, or fewer with
    block_tokens: int = 16_000_000  # so many tokens
    shortest_cut: int = 32  # no example is cut to fill less room than this, but for the last sequence of a block


@dataclass
class Piece:
    example: int  # index in the block's list of examples
    start: int
    length: int
    loss: int


def place(sizes: np.ndarray, losses: np.ndarray, limits: Limits) -> list[list[int]]:
    """Bins of example indices, none over a limit; every example fits an empty bin.

    Examples of equal demand are interchangeable, so the search runs over the distinct demands.
    """
    scale = np.array([1 / limits.tokens, 1 / limits.segments, 1 / limits.loss_tokens])
    demand, which = np.unique(np.stack([sizes, np.ones_like(sizes), losses], 1), axis=0, return_inverse=True)
    waiting: list[list[int]] = [[] for _ in demand]
    for i in range(len(sizes) - 1, -1, -1):
        waiting[which.reshape(-1)[i]].append(i)
    left = np.array([len(w) for w in waiting])
    weight, full, bins = demand * scale, np.array([limits.tokens, limits.segments, limits.loss_tokens]), []
    while left.any():
        room, bin_ = full.copy(), []
        while True:
            fits = np.flatnonzero((demand <= room).all(1) & (left > 0))
            if not len(fits):
                break
            best = fits[np.argmax(weight[fits] @ (room * scale))]
            bin_.append(waiting[best].pop())
            left[best] -= 1
            room = room - demand[best]
        bins.append(bin_)
    return bins


def cut_losses(mask, start: int, length: int) -> int:
    return length if mask is None else int(mask[start : start + length].sum())


def pack_block(lengths: list[int], masks: list, limits: Limits) -> list[list[Piece]]:
    """Sequences of pieces for a block of examples; each token of each example lies in exactly one piece.

    ``masks[i]`` marks the loss-bearing tokens of example i, None: all of them.
    """
    most = min(limits.tokens, limits.loss_tokens) if any(m is None for m in masks) else limits.tokens
    sequences, rest = [], []
    for i, n in enumerate(lengths):
        start = 0
        while n - start > 0:
            length = min(most, n - start)
            while cut_losses(masks[i], start, length) > limits.loss_tokens:
                length //= 2
            piece = Piece(i, start, length, cut_losses(masks[i], start, length))
            sequences.append([piece]) if length == limits.tokens else rest.append(piece)
            start += length
    if not rest:
        return sequences
    bins = [[rest[j] for j in b] for b in place(np.array([p.length for p in rest]), np.array([p.loss for p in rest]), limits)]
    bins.sort(key=lambda b: -sum(p.length for p in b))
    # Sequences from the least full one on are dissolved as long as the others have room for their tokens.
    loose: list[Piece] = []
    room = lambda b: min(limits.tokens - sum(p.length for p in b), limits.loss_tokens - sum(p.loss for p in b)) if len(b) < limits.segments else 0
    rooms = [room(b) for b in bins]
    usable = sum(r for r in rooms if r >= limits.shortest_cut)
    while len(bins) > 1 and sum(p.length for p in bins[-1]) <= usable - max(rooms[-1], 0):
        usable -= sum(p.length for p in bins[-1]) + (rooms[-1] if rooms[-1] >= limits.shortest_cut else 0)
        loose += bins.pop()
        rooms.pop()
    for b in bins:
        while loose and (r := room(b)) > 0:
            p = loose[-1]
            if p.length > r and r < limits.shortest_cut:
                break
            loose.pop()
            take = min(r, p.length)
            b.append(Piece(p.example, p.start, take, cut_losses(masks[p.example], p.start, take)))
            if take < p.length:
                at, n = p.start + take, p.length - take
                loose.append(Piece(p.example, at, n, cut_losses(masks[p.example], at, n)))
    if loose:
        bins += [[loose[j] for j in b] for b in place(np.array([p.length for p in loose]), np.array([p.loss for p in loose]), limits)]
    full = [b for b in bins if sum(p.length for p in b) == limits.tokens]
    for b in bins:
        if (total := sum(p.length for p in b)) < limits.tokens and limits.tokens - total < limits.shortest_cut:
            full.append(b)
        elif total < limits.tokens:
            full += at_powers(b, masks)
    return sequences + full


def at_powers(pieces: list[Piece], masks: list) -> list[list[Piece]]:
    """The pieces of one sequence cut into sequences whose totals are the powers of two of the binary total."""
    out, todo = [], list(reversed(pieces))
    total = sum(p.length for p in pieces)
    for size in (1 << k for k in range(total.bit_length() - 1, -1, -1)):
        if not total & size:
            continue
        sequence = []
        while size:
            p = todo.pop()
            take = min(size, p.length)
            sequence.append(Piece(p.example, p.start, take, cut_losses(masks[p.example], p.start, take)))
            if take < p.length:
                at, n = p.start + take, p.length - take
                todo.append(Piece(p.example, at, n, cut_losses(masks[p.example], at, n)))
            size -= take
        out.append(sequence)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"
PIECES_ARROW = pa.schema([*((n, pa.int64()) for n in "doc_id start length ids_crc32 doc_tokens sequence_id offset loss_tokens".split()), ("ids", pa.binary())])


def pack_documents(docs: DataFrame, vocabulary: str = BYTE_VOCAB, end: int | None = 1, limits: Limits = Limits(), ids: bool = True) -> DataFrame:
    """Encode ``doc_id, text[, prompt_chars]`` and pack; one row per piece, with its ids unless ``ids`` is False.

    With a column ``prompt_chars``, the tokens of the first so many characters bear no loss (instruction data).
    """
    prompts = "prompt_chars" in docs.columns
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(["prompt_chars"] if prompts else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = encoder(vocabulary), TaskContext.get().partitionId() << 32, 0
        last = b"" if end is None else np.array([end], encode.width).tobytes()
        keys, examples, masks, held = [], [], [], 0

        def flush():
            nonlocal made
            columns: dict[str, list] = {n: [] for n in PIECES_ARROW.names}
            for sequence in pack_block([len(e) for e in examples], masks, limits):
                offset = 0
                for p in sequence:
                    own = examples[p.example][p.start : p.start + p.length]
                    row = (keys[p.example], p.start, p.length, crc32(own), len(examples[p.example]), base + made, offset, p.loss, own.astype("<u4").tobytes() if ids else None)
                    for n, v in zip(columns, row, strict=True):
                        columns[n].append(v)
                    offset += p.length
                made += 1
            keys.clear(), examples.clear(), masks.clear()
            return pa.RecordBatch.from_pydict(columns, PIECES_ARROW)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = batch.column(2).to_pylist() if prompts else [None] * len(texts)
            for a, b in slices(texts):
                heads = encode([t[: s or 0] for t, s in zip(texts[a:b], starts[a:b], strict=True)]) if prompts else [b""] * (b - a)
                for key, got, head, prompt in zip(names[a:b], encode(texts[a:b]), heads, starts[a:b], strict=True):
                    own = np.frombuffer(got + last, encode.width)
                    keys.append(key)
                    examples.append(own)
                    masks.append(None if prompt is None else np.arange(len(own)) >= len(head) // own.itemsize)
                    held += len(own)
                    if len(examples) >= limits.block or held >= limits.block_tokens:
                        held = 0
                        yield flush()
        if examples:
            yield flush()

    out = chosen.mapInArrow(run, PIECES)
    return out if ids else out.drop("ids")


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), BYTE_VOCAB, 1, ids=False)
