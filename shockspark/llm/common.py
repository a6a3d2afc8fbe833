"""Helpers shared by the operators: column access, temporary names, shipping of the
package to Python workers, and intermediate tables in the shared folder."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shockspark.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(at(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, base: str) -> str:
    """``base``, with underscores appended until no column of ``df`` has the name
    (names compare without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator's own output columns would clash with."""
    gone = {n.lower() for n in names}
    return df.select(*[at(c) for c in df.columns if c.lower() not in gone])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the folder of ``spark.checkpoint.dir`` and read
    back: cuts the lineage on storage that all executors share."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make ``shockspark`` importable in the Python workers, once per application.  The
    zip is made on the driver and served to the executors by Spark (``addPyFile``)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for root, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    path = os.path.join(tempfile.mkdtemp(prefix="shockspark-py-"), "shockspark_src.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
