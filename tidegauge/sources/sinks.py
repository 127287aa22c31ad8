"""Idempotent keyed writes over Parquet tables: merges, inserts, replacements, purges, and publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas

#: The columns that a conflict updates, by table; others keep their first value.
UPDATES: dict[str, tuple[str, ...]] = {
    "markets": ("title", "target", "close_time", "status", "resolved_outcome", "resolution_time", "tracked"),
    "stances": ("stance", "confidence", "disagreement"),
    "market_prices": ("yes_price", "yes_bid", "yes_ask", "spread", "depth_bid", "depth_ask", "volume"),
    "signals": ("s_t", "p_hat", "calibration", "n_posts", "weight_sum", "half_life_seconds"),
    "sim_prices": ("sim_price", "b", "q_yes", "q_no", "cost", "trade_size", "signal"),
    "granger_results": ("p_value", "p_value_adj", "significant"),
}
CHANNELS = {"signals": "signals", "sim_prices": "sim", "market_prices": "prices"}


def latest_of_batch(new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key of a batch: the last by ``order``, or any if it doesn't matter."""
    if not order:
        return new.dropDuplicates(key)
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, *, key: list[str], update: list[str], keep_if_null: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new``: on a conflict only ``update`` changes, and of these ``keep_if_null`` only to values.

    ``new`` has each key once; both sides are exchanged by key once. The result has the columns of ``old``.
    """
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in old.columns], F.lit(True).alias("n_here"))
    o = old.withColumn("o_here", F.lit(True))
    joined = o.join(n, [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in key], "full")

    def column(c: str) -> Column:
        fresh, was = F.col(f"n_{c}"), F.col(c)
        if c not in update:
            return F.when(F.col("o_here"), was).otherwise(fresh)
        if c in (keep_if_null or []):
            return F.coalesce(fresh, was)
        return F.when(F.col("n_here"), fresh).otherwise(was)

    return joined.select(*[column(c).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, *, key: list[str]) -> DataFrame:
    """``old`` with those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def replace_groups(old: DataFrame, new: DataFrame, *, group: list[str]) -> DataFrame:
    """``old`` with all rows of the groups in ``new`` replaced."""
    return old.join(new.select(*group).distinct(), group, "left_anti").select(*old.columns).unionByName(new.select(*old.columns).distinct())


def purge(df: DataFrame, *, on: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, purged) by a time; on a table partitioned by date the filter prunes partitions."""
    return df.where(F.col(on) >= cutoff), df.where(F.col(on) < cutoff)


class ParquetStore:
    """Tables as Parquet folders, each version in a folder of its own; a one-line file names the current one.

    A write makes a new version and then moves the name, so a failed job leaves the old version whole, and a job run
    again on its input changes nothing. One writer a table. Both go through Spark's file systems.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self, table: str) -> str | None:
        fs, p = self._fs(f"{self.root}/{table}/CURRENT")
        return self.spark.read.text(p.toString()).first()[0] if fs.exists(p) else None

    def read(self, table: str) -> DataFrame:
        version = self._current(table)
        if version is None:
            return self.spark.createDataFrame([], schemas.TABLES[table])
        return schemas.read_table(self.spark, f"{self.root}/{table}/{version}", table)

    def write(self, table: str, df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{table}/{version}")
        self._point(table, version)
        return self.read(table)

    def _point(self, table: str, version: str) -> None:
        """The name is written beside the current one and then takes its place in one step: readers see one or the other."""
        sc = self.spark.sparkContext
        fs, fresh = self._fs(f"{self.root}/{table}/.CURRENT-{version}")
        out = fs.create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        _, current = self._fs(f"{self.root}/{table}/CURRENT")
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(fresh), fs.makeQualified(current), how)

    def upsert(self, table: str, new: DataFrame) -> DataFrame:
        key = list(schemas.KEYS[table])
        old = self.read(table)
        full = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in old.dtypes])
        return self.write(table, merge(old, latest_of_batch(full, key), key=key, update=list(UPDATES[table])))

    def insert(self, table: str, new: DataFrame) -> int:
        """Rows whose key is new are added; their number is returned."""
        old = self.read(table)
        before = old.count()
        full = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in old.dtypes])
        return self.write(table, insert_missing(old, full, key=list(schemas.KEYS[table]))).count() - before

    def append(self, table: str, new: DataFrame) -> DataFrame:
        return self.write(table, self.read(table).unionByName(new, allowMissingColumns=True))


def messages(df: DataFrame, table: str) -> DataFrame:
    """(channel, payload): each row as JSON with RFC 3339 times, nulls written; rows that break a constraint raise."""
    held = df
    for check in schemas.CHECKS[table]:
        names = [c for c in schemas.KEYS[table]]
        message = F.concat(F.lit(f"{table}: {check} fails for "), F.concat_ws("/", *[F.col(n).cast("string") for n in names]))
        held = held.where(F.when(F.coalesce(F.expr(check), F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))
    payload = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    return held.select(F.concat(F.lit(f"{CHANNELS.get(table, table)}:"), F.col("market_id")).alias("channel"), payload.alias("payload"))
