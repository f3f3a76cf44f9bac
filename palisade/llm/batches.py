"""Columns computed from whole texts, batch by batch, beside the columns that a table already has."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palisade.llm.tables import small_batches
from palisade.llm.words import by_bytes

#: name -> (Spark type, Arrow type)
Added = dict[str, tuple[str, pa.DataType]]
LONG, DOUBLE, TEXT, FLAG, INT = ("long", pa.int64()), ("double", pa.float64()), ("string", pa.string()), ("boolean", pa.bool_()), ("int", pa.int32())


def with_text_columns(
    docs: DataFrame, text: str, added: Added, start: Callable[[], Callable[[list[bytes]], dict[str, Iterable]]],
    keep: Iterable[str] | None = None, rows: int = 1000, limit: int = 2_000_000,
) -> DataFrame:
    """``start()`` runs once per task and returns the function from texts (null: empty) to the added columns.

    ``keep`` names the columns that stay (default: all). A column that has an added column's name is replaced.
    """
    small_batches(docs.sparkSession, rows)
    taken = {c.lower() for c in added}
    wanted = None if keep is None else {c.lower() for c in keep}
    kept = [i for i, f in enumerate(docs.schema) if f.name.lower() not in taken and (wanted is None or f.name.lower() in wanted)]
    place = next(i for i, f in enumerate(docs.schema) if f.name.lower() == text.lower())
    schema = [docs.schema[i] for i in kept]
    schema = T.StructType([*schema, *T.StructType.fromDDL(", ".join(f"{name} {ddl}" for name, (ddl, _) in added.items()))])
    names = schema.names
    # only what is needed crosses to Python, under names that cannot clash
    sent = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in sorted({*kept, place})])
    order = {int(c[1:]): k for k, c in enumerate(sent.columns)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            texts = batch.column(order[place]).to_pylist()
            columns: dict[str, list] = {name: [] for name in added}
            for _, run in by_bytes(texts, limit):
                for name, values in compute(run).items():
                    columns[name].extend(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(order[i]) for i in kept] + [pa.array(columns[name], type=kind) for name, (_, kind) in added.items()], names=names)

    return sent.mapInArrow(work, schema)
