"""Neighbouring rows in one global order, without a task that holds a whole group.

A window partitioned by context or entity puts a hot group into one task. Here the rows are range-partitioned by
(group, order) and sorted, so that every task holds an equal share however the groups are sized. One Arrow pass over each
sorted range compares neighbours; no second shuffle brings the ranges together again. What crosses the edges of ranges
is settled on the driver from the first and last row of each range, at most two per shuffle partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.session import partitions, staged

#: (rows before, rows here), both with the carried columns only -> whether each row opens something new.
Differs = Callable[[pa.Table, pa.Table], np.ndarray]


def unequal(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Whether values differ, where null equals only null."""
    a, b = a.combine_chunks(), b.combine_chunks()
    return ~(np.asarray(pc.fill_null(pc.equal(a, b), False)) | (np.asarray(a.is_null()) & np.asarray(b.is_null())))


def _struct(rows: pa.Table, kind: pa.DataType, wanted: tuple[str, ...], edge: bool) -> pa.Array:
    """The carried columns of a table as one struct array; fields not wanted are null, but for the first row if it is at an edge."""
    n = rows.num_rows
    fields = []
    for f in kind:
        values = rows.column(f.name).combine_chunks().cast(f.type)
        if f.name not in wanted:
            values = pa.concat_arrays([values.slice(0, 1), pa.nulls(n - 1, f.type)]) if edge and n else pa.nulls(n, f.type)
        fields.append(values)
    return pa.StructArray.from_arrays(fields, fields=list(kind))


def stretches(df: DataFrame, by: list[str], carry: list[str], differs: Differs, last: tuple[str, ...] = (), next_: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """df's rows that open a stretch in the order of `by`, each with its stretch; staged.

    A row opens a stretch if `differs` says so of it and the row just before; the first of all always does. Added are
    `_last`, the struct of the given columns of its last row, `_next`, that of the row that opens the next stretch (null
    at the end), and `_count`, its number of rows. `last` and `next_` name some of `carry`, the columns that `differs`
    sees. Rows that open nothing go no further than the task that sees them. Nulls sort first; ties on all of `by` come
    in an arbitrary but fixed order.
    """
    spark = df.sparkSession
    kinds = T.StructType([T.StructField(c, df.schema[c].dataType) for c in carry])
    extra = [("_range", T.IntegerType()), ("_row", T.LongType()), ("_final", T.BooleanType()), ("_count", T.LongType()), ("_last", kinds), ("_next", kinds)]
    schema = T.StructType(df.schema.fields + [T.StructField(n, t) for n, t in extra])
    ordered = df.repartitionByRange(ranges or partitions(spark), *by).sortWithinPartitions(*by)
    local = staged(ordered.mapInArrow(_local_stretches(schema, carry, differs, last, next_), schema), "stretches")

    ends = local.filter("_row = 0 OR _final").select("_range", "_row", "_final", "_count", "_last", "_next", F.struct(*carry).alias("_own")).collect()
    first = sorted((r for r in ends if r["_row"] == 0), key=lambda r: r["_range"])
    final = sorted((r for r in ends if r["_final"]), key=lambda r: r["_range"])
    opens = [True, *_across(differs, kinds, [r["_last"] for r in final[:-1]], [r["_own"] for r in first[1:]])]
    edges, end, after, more = [], None, None, 0
    for k in reversed(range(len(first))):
        # What the last stretch of this range still gets from the ranges behind it.
        if k + 1 == len(first) or opens[k + 1]:
            end, after, more = final[k]["_last"], first[k + 1]["_own"] if k + 1 < len(first) else None, 0
        elif first[k + 1]["_final"]:
            more += first[k + 1]["_count"]
        else:
            end, after, more = first[k + 1]["_last"], first[k + 1]["_next"], first[k + 1]["_count"]
        edges.append((first[k]["_range"], opens[k], end, after, more))
    shape = T.StructType([T.StructField(n, t) for n, t in [("_range", T.IntegerType()), ("_opens", T.BooleanType()), ("_end", kinds), ("_after", kinds), ("_more", T.LongType())]])
    joined = local.join(F.broadcast(spark.createDataFrame(edges, shape)), "_range").filter((F.col("_row") > 0) | F.col("_opens"))

    def part(inner: str, edge: str, names: tuple[str, ...]) -> Column:
        """The named fields of a struct, taken from the edges for the last stretch of a range."""
        whole = F.when(F.col("_final"), F.col(edge)).otherwise(F.col(inner))
        return F.when(whole.isNotNull(), F.struct(*[whole[c].alias(c) for c in names]) if names else F.struct(F.lit(True).alias("there"))).alias(inner)

    count = F.col("_count") + F.when(F.col("_final"), F.col("_more")).otherwise(0)
    return joined.select(*df.columns, part("_last", "_end", last), part("_next", "_after", next_), count.alias("_count"))


def _across(differs: Differs, kinds: T.StructType, before: list, here: list) -> list[bool]:
    shape = to_arrow_schema(kinds)
    tables = [pa.Table.from_pylist([r.asDict() for r in rows], shape) for rows in (before, here)]
    return [bool(x) for x in differs(*tables)] if here else []


def _local_stretches(schema: T.StructType, carry: list[str], differs: Differs, last: tuple[str, ...], next_: tuple[str, ...]):
    """The stretches of one sorted range. Columns that only the edges need are null elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(schema)
        kind, number = shape.field("_last").type, TaskContext.get().partitionId()
        seen, tail, begun, begun_before, begun_at = 0, None, None, None, np.empty(0, np.int64)

        def rows(starts: pa.Table, at: np.ndarray, ends: pa.Array, after: pa.Array, until: np.ndarray, final: bool) -> Iterator[pa.RecordBatch]:
            n = len(at)
            more = [pa.array(np.full(n, number, np.int32)), pa.array(at), pa.array(np.full(n, final)), pa.array(until - at), ends, after]
            yield from pa.Table.from_arrays([c.combine_chunks().cast(f.type) for c, f in zip(starts.columns, shape)] + more, schema=shape).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            here = whole.select(carry)
            before = pa.concat_tables([here.slice(0, 1) if tail is None else tail, here.slice(0, batch.num_rows - 1)])
            opens = np.array(differs(before, here))
            opens[0] |= tail is None
            new = np.flatnonzero(opens)
            tail = here.slice(batch.num_rows - 1)
            if len(new):
                starts, befores, at = whole.take(new), before.take(new), seen + new
                if begun is not None:
                    starts, befores, at = pa.concat_tables([begun, starts]), pa.concat_tables([begun_before, befores]), np.concatenate([begun_at, at])
                n, edge = len(at) - 1, at[0] == 0
                if n:
                    yield from rows(starts.slice(0, n), at[:n], _struct(befores.slice(1), kind, last, edge), _struct(starts.select(carry).slice(1), kind, next_, edge), at[1:], False)
                begun, begun_before, begun_at = starts.slice(n), befores.slice(n), at[n:]
            seen += batch.num_rows
        if begun is not None:
            yield from rows(begun, begun_at, _struct(tail, kind, last, True), pa.nulls(1, kind), np.array([seen]), True)

    return run


def running_total(df: DataFrame, group: str, by: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """df with `_before`, the sum of `value` over the rows of the same group that come before in the order of `by`. Staged.

    Range-partitioned by (group, by), so a hot group is split. Only the first group of a range can go on from the range
    before; so what is broadcast is one row per range, however many groups there are. Null values count as 0, null
    groups are one group.
    """
    spark = df.sparkSession
    extra = [("_range", T.IntegerType()), ("_edge", T.IntegerType()), ("_going", T.BooleanType()), ("_here", T.LongType())]
    schema = T.StructType(df.schema.fields + [T.StructField(n, t) for n, t in extra])
    ordered = df.repartitionByRange(ranges or partitions(spark), group, *by).sortWithinPartitions(group, *by)
    rows = staged(ordered.mapInArrow(_local_totals(schema, group, value), schema), "running")
    # The last row of each range tells what its last group has come to, and whether that is its first group as well.
    ends = rows.filter("_edge > 0").select("_range", "_edge", "_going", (F.col("_here") + F.coalesce(F.col(value), F.lit(0))).cast("long").alias("_sum"), F.col(group).alias("_group")).collect()
    first = {r["_range"]: r["_group"] for r in ends if r["_edge"] & 1}
    carried, over, at = [], 0, None
    for r in sorted((r for r in ends if r["_edge"] & 2), key=lambda r: r["_range"]):
        over = over if carried and first[r["_range"]] == at else 0
        carried.append((r["_range"], over))
        over, at = r["_sum"] + (over if r["_going"] else 0), r["_group"]
    edges = F.broadcast(spark.createDataFrame(carried, "_range int, _carried long"))
    return rows.join(edges, "_range").select(*df.columns, (F.col("_here") + F.when(F.col("_going"), F.col("_carried")).otherwise(0)).alias("_before"))


def _local_totals(schema: T.StructType, group: str, value: str):
    """Adds the number of the range, 1 for its first row and 2 for its last (3 for both), whether the row is in the range's first
    group, and the sum of its group before it inside the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(schema)
        number, going, total, last, held, seen = TaskContext.get().partitionId(), True, 0, None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = pa.Table.from_batches([batch])
            own = whole.select([group])
            new = unequal(pa.concat_tables([own.slice(0, 1) if last is None else last, own.slice(0, n - 1)]).column(0), own.column(0))
            last = own.slice(n - 1)
            amount = pc.fill_null(whole.column(value).combine_chunks().cast(pa.int64()), 0).to_numpy()
            sums = np.concatenate([[0], np.cumsum(amount)[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the group goes on from the batch before
            here = sums - np.where(begin < 0, -total, sums[begin])
            total = int(here[-1] + amount[-1])
            inside = going & ~np.logical_or.accumulate(new)
            going = bool(inside[-1])
            edge = np.where(np.arange(n) + seen == 0, 1, 0).astype(np.int32)
            seen += n
            out = pa.Table.from_arrays([c.combine_chunks().cast(f.type) for c, f in zip(whole.columns, shape)] + [pa.array(np.full(n, number, np.int32)), pa.array(edge), pa.array(inside), pa.array(here)], schema=shape)
            if held is not None:
                yield from held.to_batches()
            held = out.slice(n - 1)
            yield from out.slice(0, n - 1).to_batches()
        if held is not None:
            place = len(shape) - 3
            yield from held.set_column(place, shape.field(place), pa.array([int(held.column(place)[0].as_py()) | 2], pa.int32())).to_batches()

    return run
