"""Readers and writers: the partitioned bar lake, small dimensions and the driver's tables as bars."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import in_session, valid_bar
from barloom.schema import BARS

KEY = ["symbol", "timeframe", "timestamp"]


def prepare(rows: DataFrame) -> DataFrame:
    """Rows in the lake's schema: missing columns null, volume 0 for null, invalid and off-session bars gone."""
    have = set(rows.columns)
    typed = [(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in BARS.fields]
    extra = [c for c in rows.columns if c not in BARS.names and c not in ("year", "month")]
    out = rows.select(*typed, *extra).withColumn("volume", F.coalesce("volume", F.lit(0).cast("long")))
    return out.filter(valid_bar() & in_session(F.col("timestamp"), weekdays_only=True))


def write_lake(rows: DataFrame, root: str) -> None:
    """Replace the symbol-months that ``rows`` touch."""
    dated = rows.withColumns({"year": F.year("timestamp"), "month": F.month("timestamp")})
    spread = dated.repartition("symbol", "year", "month")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year", "month").parquet(root)


def read_lake(spark: SparkSession, root: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, timeframe: str | None = None, session_only: bool = True, skip_corrupt: bool = False) -> DataFrame:
    """Bars between inclusive bounds; partitions are pruned by symbol and month. An empty symbol list gives no rows.

    A corrupt file is an error, unless ``skip_corrupt``; see ``quarantine``, which says which files it takes away.
    """
    schema = T.StructType([*BARS.fields, T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(root)
    if symbols is not None:
        rows = rows.filter(F.col("symbol").isin(symbols) if symbols else F.lit(False))
    for bound, after in ((start, True), (end, False)):
        if bound is not None:
            at = F.lit(bound).cast("timestamp_ntz")
            month = F.year(at) * 100 + F.month(at)
            own, stamp = F.col("year") * 100 + F.col("month"), F.col("timestamp")
            rows = rows.filter((own >= month) & (stamp >= at) if after else (own <= month) & (stamp <= at))
    if timeframe is not None:
        rows = rows.filter(F.col("timeframe") == timeframe)
    return rows.filter(in_session(F.col("timestamp"), weekdays_only=True)) if session_only else rows


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those of equal key; the last of equal incoming keys wins."""
    one = Window.partitionBy(*KEY).orderBy(F.desc("_n"))
    fresh = prepare(incoming).withColumn("_n", F.monotonically_increasing_id()).withColumn("_r", F.row_number().over(one))
    fresh = fresh.filter("_r = 1").drop("_n", "_r")
    return existing.join(fresh.select(*KEY), KEY, "left_anti").unionByName(fresh, allowMissingColumns=True)


def load_window(lake: DataFrame, start: str, end: str, symbols: list[str], fallback: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """Bars between inclusive bounds with their ``origin``: the lake's, or, for symbols that it has none of, those of ``fallback``.

    ``fallback`` is asked once, for the missing symbols alone, and only if there are any.
    """
    inside = F.col("timestamp").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    own = lake.filter(F.col("symbol").isin(symbols) & inside)
    if fallback is None:
        return own.withColumn("origin", F.lit("lake"))
    have = {r["symbol"] for r in own.select("symbol").distinct().collect()}  # of the symbols asked for
    missing = sorted(set(symbols) - have)
    if not missing:
        return own.withColumn("origin", F.lit("lake"))
    more = fallback(missing).filter(F.col("symbol").isin(missing) & inside)
    return own.withColumn("origin", F.lit("lake")).unionByName(more.withColumn("origin", F.lit("fallback")), allowMissingColumns=True)


def upsert_lake(spark: SparkSession, root: str, incoming: DataFrame) -> int:
    """Merge rows into the lake by key and give the number of valid incoming rows.

    Only the symbol-months that ``incoming`` touches are read and rewritten. They
    are staged beside the lake first, as a table can't be overwritten while it is read.
    """
    fresh = prepare(incoming).withColumns({"year": F.year("timestamp"), "month": F.month("timestamp")})
    touched = fresh.select("symbol", "year", "month").distinct()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stage = f"{root.rstrip('/')}-staged-{uuid.uuid4().hex}"
    try:
        if files.exists(path) and not spark.read.parquet(root).isEmpty():
            # a broadcast of the touched partitions lets the scan skip all others
            old = read_lake(spark, root, session_only=False).join(F.broadcast(touched), ["symbol", "year", "month"], "left_semi").drop("year", "month")
            whole = upsert(old, incoming)
        else:
            whole = upsert(fresh.drop("year", "month").limit(0), incoming)
        whole.withColumns({"year": F.year("timestamp"), "month": F.month("timestamp")}).write.parquet(stage)
        staged = spark.read.parquet(stage)
        write_lake(staged.drop("year", "month"), root)
        return fresh.count()
    finally:
        files.delete(jvm.org.apache.hadoop.fs.Path(stage), True)


def schema_of(views: dict[str, DataFrame], name: str) -> DataFrame:
    """name and kind of each column of a view; an unknown view is an error."""
    if name not in views:
        raise ValueError(f"unknown view {name}; known are {', '.join(sorted(views))}")
    df = views[name]
    return df.sparkSession.createDataFrame(df.dtypes, "name string, kind string")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Constituents of a universe file, of the cash series only."""
    return spark.read.csv(path, header=True).filter(F.col("Series").isin("EQ", "BE"))


def dataset_fingerprint(rows: DataFrame, policy: str = "session") -> DataFrame:
    """One row with a digest over the files that hold ``rows``."""
    files = rows.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    line = F.concat_ws("|", "p", F.col("s").cast("string"), F.unix_micros("t").cast("string"))
    return files.agg(F.sha2(F.concat_ws("\n", F.lit(policy), F.sort_array(F.collect_list(line))), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_files"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks: symbol, ts, event_id, price, volume."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    volume: Column = (1 + F.col("event_id") % 97).cast("double")
    return events.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), volume.alias("volume"))


def ohlcv(rows: DataFrame, *keys: str | Column, order: tuple[str, ...] = ("ts", "event_id"), price: str = "price", volume: str = "volume") -> DataFrame:
    """One aggregation to open, high, low, close, volume and n_bars."""
    by = F.struct(*order)
    return rows.groupBy(*keys).agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"),
        F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("n_bars"),
    )


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events table."""
    return ohlcv(ticks(spark, sf_dir), "symbol", F.date_trunc("hour", "ts").alias("ts"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the lineitem table by return flag; a line's unit price is its tick."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines.select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
    )
    return ohlcv(rows, "symbol", F.date_trunc("day", "ts").alias("ts"), order=("l_orderkey", "l_linenumber"))


# Small stores


def write_json_bars(rows: DataFrame, path: str) -> None:
    """Append bars to a store of JSON lines by symbol."""
    rows.write.mode("append").partitionBy("symbol").json(path)


def read_json_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a JSON store between inclusive bounds; of equal stamps the one written last stays, by its file's time and then its line's."""
    rows = spark.read.schema(BARS).json(path).withColumns({"_t": F.col("_metadata.file_modification_time"), "_f": F.col("_metadata.file_path"), "_n": F.monotonically_increasing_id()})
    for bound, keep in ((start, ">="), (end, "<=")):
        if bound is not None:
            rows = rows.filter(f"timestamp {keep} TIMESTAMP_NTZ '{bound}'")
    one = Window.partitionBy(*KEY).orderBy(F.desc("_t"), F.desc("_f"), F.desc("_n"))
    return rows.withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r", "_t", "_f", "_n")


def active(symbols: DataFrame, delisted: DataFrame) -> DataFrame:
    """``symbols`` without those that the delisting ledger holds."""
    return symbols.join(delisted.select("symbol"), "symbol", "left_anti")


def strikes(chain: DataFrame, reference: Column, right: str, k: int, side: str = "otm") -> DataFrame:
    """The first k strikes of a chain (underlying, strike, right) out of or in the money, from the reference outward."""
    above = (right == "CALL") == (side == "otm")
    rows = chain.filter((F.col("right") == right) & (F.col("strike") > reference if above else F.col("strike") < reference))
    order = Window.partitionBy("underlying").orderBy(F.col("strike") if above else F.desc("strike"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def nearest_strikes(chain: DataFrame, references: DataFrame) -> DataFrame:
    """``references`` (underlying, n, reference) with the nearest strike of their underlying, the lower one of two as near; those of no strike are left out.

    Strikes and references are one ordered list, in which the nearest strike is
    the last one before or the first one after; nothing is joined.
    """
    both = chain.select("underlying", F.col("strike").cast("double").alias("x"), F.col("strike").cast("double").alias("strike"), F.lit(None).cast("long").alias("n"))
    both = both.unionByName(references.select("underlying", F.col("reference").cast("double").alias("x"), F.lit(None).cast("double").alias("strike"), F.col("n").cast("long").alias("n")))
    order = Window.partitionBy("underlying").orderBy("x")
    below = F.last("strike", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("strike", ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = both.withColumns({"below": below, "above": above}).filter("n is not null")
    nearest = F.when(F.col("above").isNull() | (F.col("x") - F.col("below") <= F.col("above") - F.col("x")), F.col("below")).otherwise(F.col("above"))
    return rows.select("underlying", "n", nearest.alias("strike")).filter("strike is not null")


def unreadable_files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of the lake's files whose footers aren't Parquet's; of each file only the last bytes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root).select("path", "length")

    def tails(frames):
        from pyarrow import fs

        for pdf in frames:
            bad = []
            for path, length in zip(pdf["path"], pdf["length"]):
                uri = path if "://" in path else path.replace("file:/", "file:///", 1)
                system, inner = fs.FileSystem.from_uri(uri)
                with system.open_input_file(inner) as f:
                    bad.append(length < 12 or f.read_at(4, length - 4) != b"PAR1")
            yield pdf[bad]

    return files.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(tails, "path string, length long")


def quarantine(spark: SparkSession, root: str, aside: str) -> list[str]:
    """Move unreadable files under ``aside`` and name them; what they held has to be fetched again."""
    found = [r["path"] for r in unreadable_files(spark, root).collect()]  # broken files are few, and each is reported
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in found:
        old = hadoop.Path(path)
        files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        new = hadoop.Path(f"{aside.rstrip('/')}/{path.split(':', 1)[-1].lstrip('/')}")
        files.mkdirs(new.getParent())
        if not files.rename(old, new):
            raise OSError(f"can't move {path}")
    return found


def read_universes(spark: SparkSession, folder: str) -> DataFrame:
    """name and number of constituents of every universe file in a folder."""
    rows = spark.read.csv(f"{folder.rstrip('/')}/*.csv", header=True).withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))
    return rows.filter(F.col("Series").isin("EQ", "BE")).groupBy("name").agg(F.count(F.lit(1)).alias("n_symbols"))
