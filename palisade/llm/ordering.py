"""Places and running sums in very large ordered groups, without one task per group."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.tables import materialise

#: running sums are modulo 2^61
MASK = (1 << 61) - 1


def in_order(df: DataFrame, group: str, by: Sequence[Column], columns: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """``columns`` of ``df``, with ``at`` (the row's place in its group, from 0) and, for each long of ``sums``, ``<name>_upto`` (the sum up to
    and with the row, modulo 2^61).

    ``group`` is a long without nulls, among ``columns`` under its name; rows are ordered by ``group`` and ``by``, which must order the rows of
    a group wholly but for equal ones. Rows are sorted by ranges, so a group of any size lies in as many partitions as it needs; what a partition
    carries into the next is one row, gathered for all partitions.
    """
    ordered = df.repartitionByRange(group, *by).sortWithinPartitions(group, *by).select(*columns)
    place = ordered.columns.index(group)
    added = [ordered.columns.index(s) for s in sums]
    schema = T.StructType([*ordered.schema, *T.StructType.fromDDL(", ".join(["part int", "at long", *(f"{s}_upto long" for s in sums)]))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen, carried = None, 0, [0] * len(added)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, rows = batch.column(place).to_numpy(), np.arange(batch.num_rows)
            new = np.diff(groups, prepend=groups[0]) != 0
            new[0] = last is None or groups[0] != last
            start = np.maximum.accumulate(np.where(new, rows, -1))
            at = rows - np.where(start < 0, -seen, start)
            running = []
            for i, (k, before) in enumerate(zip(added, carried, strict=True)):
                total = np.cumsum(batch.column(k).to_numpy().astype(np.uint64))
                base = np.where(start < 0, np.uint64((1 << 64) - before) if before else np.uint64(0), np.concatenate([[np.uint64(0)], total])[np.maximum(start, 0)])
                running.append(((total - base) & np.uint64(MASK)).astype(np.int64))
                carried[i] = int(running[-1][-1])
            last, seen = groups[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rows), part), pa.int32()), pa.array(at, pa.int64()),
                                              *(pa.array(r, pa.int64()) for r in running)], names=names)

    found = materialise(ordered.mapInArrow(run, schema), "ordered")  # the rows and what is carried must stem from one run
    upto = [f"{s}_upto" for s in sums]
    tail = F.max(F.struct(group, (F.col("at") + 1).alias("n"), *upto))
    ends = found.groupBy("part").agg(F.min(group).alias("first"), tail.alias("tail")).orderBy("part").collect()
    carry, before = [], None  # one row per partition: what precedes it in the group that it begins with
    for r in ends:
        last, *state = r["tail"]
        if before and before[0] == r["first"]:
            carry.append((r["part"], *before))
            if last == r["first"]:  # one group fills the partition
                state = [a + b for a, b in zip(state, before[1:], strict=True)]
        before = (last, state[0], *(s & MASK for s in state[1:]))
    # by partition number, as constants: no join
    by_part = {part: state for part, *state in carry}
    width = max(by_part, default=-1) + 1
    carried = [F.from_json(F.lit(json.dumps([by_part[p][i] if p in by_part else None for p in range(width)])), "array<bigint>") for i in range(2 + len(sums))]
    goes_on = F.get(carried[0], F.col("part")) == F.col(group)
    more = [F.when(goes_on, F.get(c, F.col("part"))).otherwise(0) for c in carried[1:]]
    whole = [(F.col("at") + more[0]).alias("at")]
    whole += [(F.col(s) + m).bitwiseAND(MASK).alias(s) for s, m in zip(upto, more[1:], strict=True)]
    return found.select(*ordered.columns, *whole)
