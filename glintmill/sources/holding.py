"""Frames that are kept in memory and on disk while they are in use, and let go together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, list[DataFrame]] = {}
_named: dict[tuple, tuple[tuple, DataFrame]] = {}


def hold(df: DataFrame) -> DataFrame:
    """``df``, computed once for all that read it until :func:`release`; lost parts are made again."""
    out = df.persist()
    _held.setdefault(df.sparkSession.sparkContext.applicationId, []).append(out)
    return out


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table has changed: its length, number of files and time of change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return ()
    content = files.getContentSummary(at)
    return content.getLength(), content.getFileCount(), files.getFileStatus(at).getModificationTime()


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], tables: tuple[str, ...] = ("documents", "benchmark")) -> DataFrame:
    """A frame that several queries of one session share, made anew when a table that it comes from has changed."""
    key, now = (spark.sparkContext.applicationId, sf_dir, name), tuple(stamp(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    then, df = _named.get(key, (None, None))
    if then != now:
        if df is not None:
            df.unpersist()
        _named[key] = now, make().persist()
    return _named[key][1]


def release(spark: SparkSession) -> None:
    """Lets go of all that is held for this session."""
    app = spark.sparkContext.applicationId
    for df in _held.pop(app, []):
        df.unpersist()
    for key in [k for k in _named if k[0] == app]:
        _named.pop(key)[1].unpersist()
