"""Cutting lineage through tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets an own one, removed at exit; a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
        atexit.register(shutil.rmtree, path[len("file://"):], True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, tag: str = "t", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Every executor can read the files, so a lost executor costs no recomputation
    and later plans prune columns and push filters into this table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    _tables.append((spark, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


_kept: dict[tuple, object] = {}
FILES = 1000


def signature(df: DataFrame) -> tuple | None:
    """Names, sizes and times of the files a table is read from; None where there are none or more than ``FILES``."""
    spark, files = df.sparkSession, df.inputFiles()
    if not 0 < len(files) <= FILES:
        return None
    out = []
    for f in sorted(files):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p)
        out.append((f, s.getLen(), s.getModificationTime()))
    return tuple(out)


def kept(name: str, tables: list[DataFrame], make):
    """``make()``, or what it gave before in this session for the same files: an index is built once and read by every query that needs it."""
    signs = [signature(t) for t in tables]
    if None in signs:
        return make()
    key = (name, tables[0].sparkSession.sparkContext.applicationId, *signs)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Delete all tables written so far; call it when the results that read them are stored. Runs at exit, too."""
    _kept.clear()
    while _tables:
        try:
            _delete(*_tables.pop())
        except Exception:  # the session has ended
            pass


atexit.register(release)


def discard(table: DataFrame) -> None:
    """Delete a written table that no later plan reads; its rows live on only in what was written from it."""
    path = getattr(table, "_written_path", None)
    if path:
        _delete(table.sparkSession, path)
