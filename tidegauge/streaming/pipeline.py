"""Structured Streaming forms: the near-duplicate window, keyed upserts of micro-batches, bounded counters, publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators import repository
from ..operators.posts import DUPLICATE_THRESHOLD
from ..operators.posts import WINDOW as CAPACITY
from ..sources import sinks

_OUT = "market_id string, post_id string, original_id string, similarity double"


def signed(posts: DataFrame) -> DataFrame:
    """Posts of a stream with shingles, signature and buckets; stateless."""
    return T.with_signatures(posts.withColumn("shingles", T.shingles(T.normalize(F.col("text")))))


class DuplicateWindow(StatefulProcessor):
    """Per market the last ``capacity`` signatures in order of arrival, and which of them each bucket holds."""

    def __init__(self, threshold: float = DUPLICATE_THRESHOLD, capacity: int = CAPACITY):
        self.threshold, self.capacity = threshold, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "n long")
        self.seen = handle.getMapState("seen", "seq long", "post_id string, signature array<long>, buckets array<string>")
        self.index = handle.getMapState("index", "bucket string", "seqs array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(["created_at", "post_id"], kind="stable")
        n = self.next.get()[0] if self.next.exists() else 0
        out = []
        for r in arrived.itertuples(index=False):
            if r.signature is None:
                continue
            mine, buckets = [int(x) for x in r.signature], list(r.buckets)
            near = sorted({q for b in buckets if self.index.containsKey((b,)) for q in self.index.getValue((b,))[0]})
            best = None
            for q in near:
                post, signature, _ = self.seen.getValue((q,))
                score = sum(x == y for x, y in zip(signature, mine)) / len(mine)
                if score >= self.threshold and (best is None or score > best[1]):
                    best = (post, score)
            if best:
                out.append((key[0], r.post_id, *best))
            self._forget(n - self.capacity)
            self.seen.updateValue((n,), (r.post_id, mine, buckets))
            for b in buckets:
                held = list(self.index.getValue((b,))[0]) if self.index.containsKey((b,)) else []
                self.index.updateValue((b,), ([*held, n],))
            n += 1
        self.next.update((n,))
        yield pd.DataFrame(out, columns=["market_id", "post_id", "original_id", "similarity"])

    def _forget(self, seq: int) -> None:
        if seq < 0 or not self.seen.containsKey((seq,)):
            return
        for b in self.seen.getValue((seq,))[2]:
            left = [q for q in self.index.getValue((b,))[0] if q != seq]
            if left:
                self.index.updateValue((b,), (left,))
            else:
                self.index.removeKey((b,))
        self.seen.removeKey((seq,))

    def close(self) -> None:
        pass


def near_duplicates(posts: DataFrame, *, threshold: float = DUPLICATE_THRESHOLD, capacity: int = CAPACITY) -> DataFrame:
    """The stream twin of the batch operator: (market_id, post_id, original_id, similarity) of each duplicate.

    Equal to the batch for posts that arrive in order; within a micro-batch they are put in order.
    """
    return signed(posts).groupBy("market_id").transformWithStateInPandas(DuplicateWindow(threshold, capacity), _OUT, "Append", "None")


def hourly_activity(posts: DataFrame, *, late: str = "7 days") -> DataFrame:
    """Posts and mean weight per market and hour; posts later than the age limit of the signal are left out."""
    return posts.withWatermark("created_at", late).groupBy("market_id", F.window("created_at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.avg(F.log1p("followers") * (1 + F.col("engagements"))).alias("mean_weight")).select("market_id", F.col("w.start").alias("hour"), "n", "mean_weight")


def fresh_ticks(ticks: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Ticks without those seen already under the same market, time and source."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["market_id", "ts", "source"])


def upsert_batches(stream: DataFrame, store: sinks.ParquetStore, table: str, checkpoint: str, *, trigger: dict | None = None, then: Callable[[DataFrame], None] | None = None):
    """Merges each micro-batch into a stored table by its key; polls may overlap, and a batch run twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        after = store.upsert(table, batch) if table in sinks.UPDATES else store.insert(table, batch)
        if then is not None and isinstance(after, DataFrame):
            then(after)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_messages(table: DataFrame, name: str) -> DataFrame:
    """What is published after a refresh: each market's last row as a message."""
    return sinks.messages(repository.latest(table, by=["market_id"], on="ts").select(*table.columns), name)


def subscribe(messages: DataFrame, pattern: str) -> DataFrame:
    """Messages whose channel fits a glob."""
    regex = "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != ":" else c) for c in pattern) + "$"
    return messages.where(F.col("channel").rlike(regex))


def distinct_until_changed(rows: DataFrame, *, by: str = "market_id", on: str = "ts") -> DataFrame:
    """Polled rows (numbered by ``poll``) without those whose time is that of the row before."""
    w = Window.partitionBy(by).orderBy("poll")
    return rows.withColumn("_last", F.lag(on).over(w)).where(~F.col(on).eqNullSafe(F.col("_last"))).drop("_last")


def parquet_stream(spark: SparkSession, path: str, schema: str, *, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
