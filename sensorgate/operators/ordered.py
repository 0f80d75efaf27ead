"""Scans along an order, in one exchange and one read of the input, for keys of any size.

Rows are cut in ranges of (keys, order), so a key with most of the rows spreads over as many tasks as any other rows do.
Each task walks its sorted rows once, batch by batch, with the state of the key it is in, and writes the rows with
their local results; its last row is the border summary: first and last key, and the states of both. The number of ranges
grows with the rows, so a task sorts about RANGE_ROWS of them in any table. From the summaries
(one for each task) follows what each range inherits, and the rows of its first key take that in by a join with a table
of one row for each range. Boundaries of ranges are drawn by sampling and would differ when a lost task is computed
again, so the rows are stored in the shared folder before the summaries are read.

Defined cases: NULL keys are a key; rows of equal order have any order among them; an empty table gives no row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, IntegerType, LongType, StructType

from sensorgate.session import scratch_path

RANGE_ROWS = 500_000  # a task sorts about as many


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Number of partitions for a step over ``rows`` rows: the session's, or more where these would grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


class Batch:
    """A sorted batch: its columns, where keys begin, and whether the first rows go on with the key before."""

    def __init__(self, batch: pa.RecordBatch, starts: np.ndarray):
        self.batch, self.starts, self.size = batch, starts, batch.num_rows
        self.begin = np.maximum.accumulate(np.where(starts, np.arange(self.size), 0))  # first row of the key in this batch
        self.going_on = self.begin == 0 if not starts[0] else np.zeros(self.size, bool)

    def known_before(self, known: np.ndarray, inclusive: bool) -> np.ndarray:
        """Index of the last known row of the same key up to each row, -1 where this batch has none."""
        at = np.maximum.accumulate(np.where(known, np.arange(self.size), -1))
        if not inclusive:
            at = np.concatenate([[-1], at[:-1]])
        return np.where(at >= self.begin, at, -1)


@dataclass(frozen=True)
class Count:
    """Position within the key, from 0."""

    out: str
    reads: str | None = None

    def columns(self, kind: DataType | None) -> dict[str, DataType]:
        return {self.out: LongType()}

    carried = columns

    def start(self):
        return 0

    def walk(self, b: Batch, state):
        at = np.arange(b.size) - b.begin + np.where(b.going_on, state, 0)
        return [pa.array(at)], int(at[-1]) + 1

    def join(self, before, inner):
        return before + inner

    def inherit(self, before, first) -> list:
        return [before]

    def finish(self, open_: Column) -> dict[str, Column]:
        return {self.out: F.col(self.out) + F.when(open_, F.col(f"_of_{self.out}")).otherwise(0)}


@dataclass(frozen=True)
class Sum:
    """Running sum within the key, the row included; NULL counts as nothing."""

    out: str
    reads: str

    def columns(self, kind):
        return {self.out: DoubleType()}

    carried = columns

    def start(self):
        return 0.0

    def walk(self, b: Batch, state):
        v = np.nan_to_num(b.batch[self.reads].cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False))
        total = np.cumsum(v)
        total += np.where(b.going_on, state, 0.0) - np.where(b.begin > 0, total[b.begin - 1], 0.0)
        return [pa.array(total)], float(total[-1])

    def join(self, before, inner):
        return before + inner

    def inherit(self, before, first):
        return [before]

    def finish(self, open_):
        return {self.out: F.col(self.out) + F.when(open_, F.col(f"_of_{self.out}")).otherwise(0.0)}


@dataclass(frozen=True)
class Last:
    """Last known value of the key up to the row, or before it."""

    out: str
    reads: str
    inclusive: bool = True

    def columns(self, kind):
        return {self.out: kind}

    carried = columns

    def start(self):
        return None  # or an array of one value

    def walk(self, b: Batch, state):
        values = b.batch[self.reads]
        known = values.is_valid().to_numpy(zero_copy_only=False)
        at = b.known_before(known, self.inclusive)
        held = state if state is not None else pa.nulls(1, values.type)
        pool = pa.concat_arrays([values, held, pa.nulls(1, values.type)])
        pick = np.where(at >= 0, at, np.where(b.going_on, b.size, b.size + 1))
        last = b.known_before(known, True)[-1]
        if last >= 0:
            state = values.take(pa.array([last]))
        elif not b.going_on[-1]:
            state = None
        return [pool.take(pa.array(pick))], state

    def join(self, before, inner):
        return inner if inner is not None else before

    def inherit(self, before, first):
        return [before]

    def finish(self, open_):
        return {self.out: F.coalesce(self.out, F.when(open_, F.col(f"_of_{self.out}")))}


@dataclass(frozen=True)
class First:
    """First known value of the key up to the row; NULL only in front of it."""

    out: str
    reads: str

    def columns(self, kind):
        return {self.out: kind}

    carried = columns

    def start(self):
        return None  # or an array of one value

    def walk(self, b: Batch, state):
        values = b.batch[self.reads]
        known = values.is_valid().to_numpy(zero_copy_only=False)
        heads = known & (b.known_before(known, False) < 0)  # first known row of its key in this batch
        at = b.known_before(heads, True)
        held = state if state is not None else pa.nulls(1, values.type)
        pool = pa.concat_arrays([values, held, pa.nulls(1, values.type)])
        pick = np.where(at >= 0, at, b.size + 1)
        if state is not None:
            pick = np.where(b.going_on, b.size, pick)
        return [pool.take(pa.array(pick))], None if pick[-1] > b.size else pool.take(pa.array(pick[-1:]))

    def join(self, before, inner):
        return before if before is not None else inner

    def inherit(self, before, first):
        return [before]

    def finish(self, open_):
        return {self.out: F.coalesce(F.when(open_, F.col(f"_of_{self.out}")), self.out)}


@dataclass(frozen=True)
class Changes:
    """Running count of the known rows whose value differs from (or ``falls`` below) the known one before in the key.

    The first known row counts ``first``; without ``skip_null`` every row is known, and NULL equals NULL. The state is
    (first known value of the range's first key, last known value, count, whether the key began in the range).
    """

    out: str
    reads: str
    falls: bool = False
    first: int = 0
    skip_null: bool = False

    def columns(self, kind):
        return {self.out: IntegerType(), f"_on_{self.out}": BooleanType()}

    def carried(self, kind):
        return {self.out: IntegerType(), f"_step_{self.out}": IntegerType()}

    def start(self):
        return None, None, 0, False

    def step(self, before: pa.Array | None, after: pa.Array) -> int:
        if before is None:
            return self.first
        a, b = before[0].as_py(), after[0].as_py()
        return int(b < a if self.falls else a != b)

    def walk(self, b: Batch, state):
        values = b.batch[self.reads]
        known = values.is_valid().to_numpy(zero_copy_only=False) if self.skip_null else np.ones(b.size, bool)
        codes = values.fill_null(0).to_numpy(zero_copy_only=False) if self.falls else values.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        at = b.known_before(known, False)
        moved = codes < codes[at] if self.falls else codes != codes[at]
        step = np.where(known & (at >= 0), moved, False).astype("int64")
        heads = known & (at < 0)  # first known row of its key in this batch
        step[heads & ~b.going_on] = self.first
        start, last, count, own = state
        on = np.full(b.size, start is not None)
        for k in np.flatnonzero(heads & b.going_on):  # one at most
            head = values.take(pa.array([k]))
            if own or start is not None:
                step[k] = self.step(last, head)
            else:
                start = head  # whether it counts shows at the border
            on[k:] = True
        total = np.cumsum(step)
        total = total - np.where(b.begin > 0, total[b.begin - 1], 0) + np.where(b.going_on, count, 0)
        if not b.going_on[-1]:
            last, own = None, True
        ended = b.known_before(known, True)[-1]
        last = values.take(pa.array([ended])) if ended >= 0 else last
        return [pa.array(total), pa.array(on)], (start, last, int(total[-1]), own)

    def join(self, before, inner):
        if inner[0] is None:
            return (*before[:2], before[2] + inner[2], True)
        return inner[0], inner[1], before[2] + self.step(before[1], inner[0]) + inner[2], True

    def inherit(self, before, first):
        return [before[2], 0 if first[0] is None else self.step(before[1], first[0])]

    def finish(self, open_):
        step = F.when(F.col(f"_on_{self.out}"), F.col(f"_of__step_{self.out}")).otherwise(0)
        return {self.out: F.col(self.out) + F.when(open_, F.col(f"_of_{self.out}") + step).otherwise(0)}


Step = Count | Sum | Last | First | Changes


def _walker(keys: list[str], steps: list[Step], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key = last_key = part = None
        states = firsts = None  # of the key at hand; of the range's first key
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.zeros(batch.num_rows, bool)
            for c in keys:
                codes = batch[c].dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                starts[1:] |= codes[1:] != codes[:-1]
            key = tuple(batch[c][0].as_py() for c in keys)
            if states is None:
                part, first_key, last_key = batch["_part"][0].as_py(), key, key
                states = [s.start() for s in steps]
            starts[0] = key != last_key
            b = Batch(batch, starts)
            if firsts is None and starts.any():  # the first key ends here: its state is that of the rows before
                size = int(np.flatnonzero(starts)[0])
                firsts = list(states)
                if size:
                    head = Batch(batch.slice(0, size), starts[:size])
                    firsts = [s.walk(head, state)[1] for s, state in zip(steps, states, strict=True)]
                opened = np.arange(batch.num_rows) < size
            else:
                opened = np.full(batch.num_rows, firsts is None)
            columns = []
            for k, s in enumerate(steps):
                out, states[k] = s.walk(b, states[k])
                columns += out
            last_key = tuple(batch[c][batch.num_rows - 1].as_py() for c in keys)
            given = {**dict(zip(batch.schema.names, batch.columns, strict=True)), "_open": pa.array(opened), "_edge": pa.nulls(batch.num_rows, pa.binary())}
            made = dict(zip([n for n in schema.names if n not in given], columns, strict=True))
            yield pa.RecordBatch.from_arrays([(given | made)[n].cast(schema.field(n).type) for n in schema.names], schema=schema)
        if states is not None:
            edge = pickle.dumps((first_key, last_key, firsts, states))
            row = {"_part": part, "_edge": edge}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], schema.field(n).type) for n in schema.names], schema=schema)

    return run


def _inherited(edges: list[tuple], steps: list[Step]) -> list[list]:
    """What the first key of each range has behind it, as the values of the carried columns."""
    rows, before, key = [], [s.start() for s in steps], None
    for k, (first_key, last_key, firsts, states) in enumerate(edges):
        if k == 0 or first_key != key:
            before = [s.start() for s in steps]
        single = firsts is None
        rows.append([v for s, b, f in zip(steps, before, states if single else firsts, strict=True) for v in s.inherit(b, f)])
        before = [s.join(b, n) for s, b, n in zip(steps, before, states, strict=True)] if single else states
        key = last_key
    return rows


def ordered_scan(df: DataFrame, keys, order, steps: list[Step], opened: str | None = None) -> DataFrame:
    """All rows with the results of all steps, in one exchange by (keys, order); stored in the shared folder.

    ``opened`` names a column that tells the rows of the first key of each range. The rows of every key without such rows
    lie in one range.
    """
    spark, keys, order = df.sparkSession, list(keys), list(order)
    ranges = tasks_for(spark, df.count())
    types = {f.name: f.dataType for f in df.schema}
    made = [s.columns(types.get(s.reads)) for s in steps]
    schema = StructType()
    for f in df.schema:
        schema.add(f.name, f.dataType)
    for name, kind in [("_part", IntegerType()), *(x for m in made for x in m.items()), ("_open", BooleanType()), ("_edge", BinaryType())]:
        schema.add(name, kind)
    cut = df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    path = scratch_path(spark, "ordered")
    arrow = to_arrow_schema(schema)
    cut.mapInArrow(_walker(keys, steps, arrow), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    # One row for each range.
    edges = [(r["_part"], pickle.loads(r["_edge"])) for r in rows.where("_edge IS NOT NULL").select("_part", "_edge").orderBy("_part").collect()]
    carried = [(f"_of_{n}", kind) for s in steps for n, kind in s.carried(types.get(s.reads)).items()]
    kinds = to_arrow_schema(StructType().add("_part", IntegerType()))
    for name, kind in carried:
        kinds = kinds.append(to_arrow_schema(StructType().add(name, kind)).field(0))
    values = _inherited([e for _, e in edges], steps)
    columns = [pa.array([p for p, _ in edges], pa.int32())]
    for k in range(len(carried)):
        cells, kind = [v[k] for v in values], kinds.field(k + 1).type
        if any(isinstance(c, pa.Array) for c in cells):
            columns.append(pa.concat_arrays([pa.nulls(1, kind) if c is None else c.cast(kind) for c in cells]))
        else:
            columns.append(pa.array(cells, kind))
    inherited = spark.createDataFrame(pa.Table.from_arrays(columns, schema=kinds))
    out = rows.where("_edge IS NULL").join(F.broadcast(inherited), "_part", "left")
    final: dict[str, Column] = {}
    for s in steps:
        final |= s.finish(F.col("_open"))
    return out.withColumns(final).select(*df.columns, *final, *([F.col("_open").alias(opened)] if opened else []))


def row_index(df: DataFrame, keys, order, out: str) -> DataFrame:
    """Zero-based position along ``order`` within ``keys`` (all rows if there are none)."""
    return ordered_scan(df, keys, order, [Count(out)])

