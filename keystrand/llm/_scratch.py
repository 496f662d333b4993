"""Tables written to the folder that all executors share.

Lineage is cut by writing Parquet under spark.checkpoint.dir, so that a lost
executor costs no recomputation of earlier passes.  The setting is read from
the session; only where it is unset (a local session, as in tests) a temporary
folder is taken.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = f"file://{tempfile.mkdtemp(prefix='keystrand-')}"
    return _own[key]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write(df: DataFrame, name: str, path: str | None = None, small: bool = False, files: int = 0, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back with the same schema.

    small: for what is small beside the work that makes it; it is brought together into as few files as its size asks for.
    files: for tables of bounded size, into that many files.
    """
    spark = df.sparkSession
    df = df.repartition(files) if files else df.hint("rebalance") if small else df
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keystrand_path = path
    _written.append((spark, path))
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that write() made, once nothing reads it any more."""
    delete(df.sparkSession, df._keystrand_path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver's garbage is collected; what one collection finds unused is free
    for good after the next.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def mark() -> int:
    return len(_written)


def release(since: int, *keep: DataFrame) -> None:
    """Deletes the tables written since a mark, but for those to keep; nothing may read them any more."""
    kept = {df._keystrand_path for df in keep}
    for spark, path in [x for x in _written[since:] if x[1] not in kept]:
        delete(spark, path)
    _written[since:] = [x for x in _written[since:] if x[1] in kept]


def by_ids(df: DataFrame, id_col: str, ids: DataFrame, how: str, most: int = 64 << 20) -> DataFrame:
    """df left_semi or left_anti joined with ids (one column named like id_col).

    ids must be cheap to count (a written table).  Up to `most` bytes of them are broadcast, so that
    df is not shuffled; more go through a shuffle join.
    """
    column = F.col(f"`{id_col}`")
    wide = isinstance(ids.schema[id_col].dataType, (StringType, BinaryType))
    size = ids.agg(F.coalesce(F.sum(F.lit(16) + (F.coalesce(F.octet_length(column), F.lit(0)) if wide else F.lit(0))), F.lit(0))).first()[0]
    return df.join(F.broadcast(ids) if size <= most else ids.hint("merge"), id_col, how)


_written: list = []


@atexit.register
def clear() -> None:
    """Deletes all tables that are left; call it before a session is stopped in a process that goes on."""
    import contextlib
    import shutil

    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have been stopped
            delete(spark, path)
    _written.clear()
    for path in _own.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    _own.clear()
