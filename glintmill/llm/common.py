"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to a Python worker: texts can be long.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
#: A side of a join of at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000

_own_folders: dict[str, str] = {}
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, as in tests; a cluster must name one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir isn't set: executors of a cluster need a folder that all of them share")
    app = context.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="glintmill-")
    return _own_folders[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it again. What was written goes when the driver ends, if not before."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glintmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what :func:`materialise` wrote, when nothing reads it any more."""
    path = getattr(df, "_glintmill_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has ``path``, which must be there, deleted when the driver's JVM ends in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def text_key(doc_id, text) -> F.Column:
    """What tells rows apart by id and text: two hashes of 64 bits that chain the two in different orders."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(text, F.lit(1), doc_id).alias("b"))


def place(columns: list[str], name: str) -> int:
    """Where ``name`` is: the exact name first, then the name in another case."""
    for test in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(columns):
            if test(c):
                return i
    raise ValueError(f"no column {name} among {columns}")


def kind(df: DataFrame, name: str) -> str:
    """The type of a column, as a schema has it: ids go through an operator as they come."""
    return df.schema[place(df.columns, name)].dataType.simpleString()


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by place: further columns may repeat or clash with any name."""
    places = [place(df.columns, n) for n in names]
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def _ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once an application: their workers import it whatever their search path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="glintmill-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(at))


def python_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches, by rows and bytes, and gives the workers this package.

    The bounds stay set for the session: plans are made when results are asked for, so they can't be set back here.
    """
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; counts no further."""
    return df.limit(limit + 1).count() <= limit


def beside(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if its row count, which is checked here, is small; else Spark shuffles it."""
    return F.broadcast(df) if small(df, limit) else df
