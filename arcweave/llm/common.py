"""What the corpus operators share: Arrow loops and byte tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: UTF-8 continuation bytes: without them, bytes count code points.
CONTINUATION = bytes(range(0x80, 0xC0))
#: The white space of the word rules: blank and \x09-\x0D.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_points(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.translate(None, CONTINUATION))


def texts(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8 bytes; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: Rows whose Python objects exist at a time; Arrow batches are cut to that without copying.
SLICE = 1024


def give_back() -> None:
    """Return freed memory to the system: workers live on after their tasks, beside other stages."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
    give_back()


def map_rows(
    df: DataFrame, schema: str, rows: Callable[[dict[str, list], int], dict[str, list]], raw: tuple[str, ...] = ("text",)
) -> DataFrame:
    """``rows(columns, n)`` on each Arrow batch; columns in ``raw`` come as bytes.

    The function returns columns of one length; nothing is kept from one batch
    to the next, so memory is bounded by the batch.
    """
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = {k: texts(batch.column(i)) if k in raw else batch.column(i).to_pylist() for i, k in enumerate(names)}
            out = rows(got, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(work, struct)
