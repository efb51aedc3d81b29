"""One way to run a per-document Python function over Arrow batches, carrying chosen columns along."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "__headcast_text"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Whole texts are long rows: the session's Arrow batches are lowered to ``rows`` (never raised).

    A batch is held by the JVM and by the Python worker of each running task; at Spark's 10,000 rows that is some
    hundred megabytes an executor.
    """
    session = df.sparkSession.conf
    if not 0 < int(session.get(BATCH_ROWS)) <= rows:
        session.set(BATCH_ROWS, rows)


def with_document_columns(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list[bytes | None]], list[Sequence[Any]]]],
    slice_rows: int = 2000,
) -> DataFrame:
    """``keep`` columns of ``df`` plus computed ``fields``, one output row per input row.

    ``make()`` runs once per task and returns a function from a list of UTF-8 texts (None for null) to one
    sequence per field. Texts travel as binary, so each worker decodes only what it needs. A kept column whose name
    equals a computed field is left out: the computed one wins. Arrow batches are bounded by Spark in rows and bytes, and
    worked on in slices of ``slice_rows`` rows.
    """
    small_batches(df)
    names = {name for name, _ in fields}
    kept = [c for c in dict.fromkeys(keep) if c not in names]
    # a text that is carried along anyway is read from its own column rather than sent twice
    carried = text_col in kept and isinstance(df.schema[text_col].dataType, T.StringType)
    extra = [] if carried else [F.col(f"`{text_col}`").cast("string").cast("binary").alias(TEXT)]
    inner = df.select(*[F.col(f"`{c}`") for c in kept], *extra)
    schema = T.StructType([inner.schema[c] for c in kept] + [T.StructField(n, t, True) for n, t in fields])
    from pyspark.sql.pandas.types import to_arrow_type

    out_types = [to_arrow_type(t) for _, t in fields]
    out_names = [*kept, *(n for n, _ in fields)]
    place, width = (kept.index(text_col) if carried else len(kept)), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                columns = work(batch.column(place).cast(pa.binary()).to_pylist())
                made = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, out_types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=out_names)

    return inner.mapInArrow(run, schema)
