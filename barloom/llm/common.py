"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts vary from a few bytes to megabytes, so batches for Python workers are bounded by bytes before rows.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096
_OWN_DIR: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset in
    local mode, as in tests, a temporary folder of this process takes its place;
    on a cluster such a folder would scatter the tables, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="barloom-"))
    return _OWN_DIR[0]


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most about ``BATCH_BYTES``.

    The session's bounds on batches are lowered to those of this module; bounds
    that are lower already stay.
    """
    conf = df.sparkSession.conf
    for name, bound in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
        if now <= 0 or now > bound:
            conf.set(key, str(bound))
    return df.mapInArrow(run, schema)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The table cuts the lineage and outlives any executor. It is removed by
    ``discard``, by the ``scratch`` that it was made in, or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barloom-{tag}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark  # also if the write fails half-way
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def _remove(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone, and its folder belongs to the cluster
        return


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing will read again."""
    for t in tables:
        _remove(getattr(t, "_written_to", ""))


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete at the end what ``materialize`` wrote within, but for the tables put into the list."""
    before, kept = set(_WRITTEN), []
    yield kept
    keep = {getattr(t, "_written_to", "") for t in kept}
    for path in [p for p in _WRITTEN if p not in before and p not in keep]:
        _remove(path)


def release() -> None:
    """Delete every table that ``materialize`` has written."""
    for path in list(_WRITTEN):
        _remove(path)


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_mod(column: str, modulus: int) -> Column:
    """crc32 of the decimal text of an integer column, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def is_held_out(column: str, modulus: int, remainder: int) -> Column:
    """True for the fold that learns nothing; a null id is never held out."""
    return F.coalesce(hash_mod(column, modulus) == remainder, F.lit(False))
