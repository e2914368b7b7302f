"""Reading and writing text through Spark, so that any store it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import _spark
from arcweave.operators.local import TooLarge


#: Bytes that :func:`read_text` takes to the driver; larger files have ``scan_*``.
MAX_BYTES = 256 << 20


def read_text(path: str, max_bytes: int = MAX_BYTES) -> str:
    """A whole file; several files in order of path; TooLarge beyond ``max_bytes`` in all."""
    size = _spark().read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()["n"] or 0
    if size > max_bytes:
        raise TooLarge(f"{path} has {size} bytes, more than {max_bytes}")
    rows = _spark().read.text(path, wholetext=True).selectExpr("value", "_metadata.file_path AS p").orderBy("p").collect()
    return "".join(r["value"] for r in rows)


def read_lines(path: str) -> DataFrame:
    """(value), a row for each line, for formats whose lines stand alone."""
    return _spark().read.text(path)


def write_text(text: str, path: str) -> None:
    """One file at ``path``, through the store's own interface."""
    jvm, conf = _spark().sparkContext._jvm, _spark().sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
