"""Workers of the search for repeats look at few bytes at a time, and texts cut in segments lose no window."""

import random
import tracemalloc

import pyarrow as pa

from sensorgate.llm import suffixes


class Given:
    """Stands for a frame: hands the function over batches back."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def anchored(texts, length=400):
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([7] * n, pa.int64()), pa.array(texts)], ["doc_id", "tie", "text"])
    return suffixes.anchored(Given(), length)(iter([batch]))


def text_of(n, seed):
    return random.Random(seed).randbytes(n // 2).hex()


def test_a_batch_of_texts_is_not_held_at_once():
    texts = [text_of(20_000, k) for k in range(400)]
    tracemalloc.start()
    try:
        for _ in anchored(texts):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80_000_000


def test_segments_of_a_huge_text_keep_every_window():
    size = 9_000_000
    at = 0
    rows = [(s, w) for b in anchored([text_of(size, 1), "x" * 399]) for d, s, w in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "windows")), strict=True) if d == 0]
    for start, count in sorted(rows):
        assert start == at
        at += count
    assert at == size - 400 + 1
