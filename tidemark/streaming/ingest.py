"""Interactions from a stream: folded batch by batch onto the state, and optionally fitted.

The state lies in buckets by user. A batch reads and rewrites only the buckets of its users, each as a new version;
the manifest names the version of every bucket, the number of the last batch, the clock and the last arrival. A batch
that comes again after a failure finds its number there and is left out. What a batch replaced is deleted by the
batch after it, so a reader has one batch's time to read the version it began with.

Defined results: rows with unknown parts are left out; a batch without rows only advances the number; without a seq,
or where it is null, rows arrive in the order of their times, after all earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import interactions as ops
from ..session import discard, materialize
from ..storage import Folder

SCHEMA = "user long, item long, tstamp double, rating double, seq long"
#: Parts of the state; a batch rewrites those that hold its users.
BUCKETS = 64


class StateTable:
    """The state of all pairs in a folder of the file system that the path names."""

    def __init__(self, spark: SparkSession, path: str, config: ops.StateConfig = ops.StateConfig(), buckets: int = BUCKETS):
        self.spark, self.config, self.buckets, self.folder = spark, config, buckets, Folder(spark, path)

    @property
    def current(self) -> dict:
        none = {"batch": -1, "clock": None, "last": -1, "buckets": self.buckets, "versions": {}, "schema": None, "replaced": []}
        return self.folder.current() or none

    def _read(self, now: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """The state of the given buckets, or of all; None without any."""
        wanted = [(b, v) for b, v in now["versions"].items() if buckets is None or int(b) in buckets]
        if not wanted:
            return None
        return self.spark.read.schema(now["schema"]).parquet(*(f"{self.folder.path}/state-{v}/bucket={b}" for b, v in wanted))

    def read(self) -> DataFrame | None:
        """(user, item, value, tstamp) of all pairs; None before the first batch."""
        return self._read(self.current)

    def apply(self, batch: DataFrame, number: int) -> bool:
        """Fold a batch; False if it had been applied before."""
        now = self.current
        if number <= now["batch"]:
            return False
        self.folder.make()
        good = ops.split_valid(batch)[0]
        known = "seq" in batch.columns and good.where("seq is null").isEmpty()
        good = materialize(ops.standard(good, "seq" if known else None, now["last"]), "arrivals")
        bucket = F.pmod(F.xxhash64("user"), F.lit(now["buckets"])).cast("int")
        touched = sorted(r["b"] for r in good.select(bucket.alias("b")).distinct().collect())
        versions, replaced, schema = dict(now["versions"]), [], now["schema"]
        if touched:
            state = ops.fold(good, self.config, self._read(now, touched), now["clock"])
            schema = ", ".join(f"{n} {t}" for n, t in state.dtypes)
            state.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.path}/state-{number}")
            replaced = [f"state-{versions[str(b)]}/bucket={b}" for b in touched if str(b) in versions]
            versions |= {str(b): number for b in touched}
        tops = [x for x in (now["clock"], ops.clock(good)) if x is not None]
        self.folder.commit(number, {
            "batch": number, "clock": max(tops) if tops else None, "last": max(now["last"], ops.last_arrival(good)), "buckets": now["buckets"],
            "versions": versions, "schema": schema, "replaced": replaced,
        })
        discard(good)
        for old in now["replaced"]:
            self.folder.delete(old)
        return True


def json_interactions(raw: DataFrame, value: str = "value") -> DataFrame:
    """Records of a message stream: JSON text or bytes with user, item, tstamp, rating and seq."""
    return raw.select(F.from_json(F.col(value).cast("string"), SCHEMA).alias("r")).select("r.*")


def stream_files(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def start(stream: DataFrame, table: StateTable, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Fold the stream into the table; `after` is called with each applied batch, for instance to fit a model."""

    def each(batch: DataFrame, number: int) -> None:
        if table.apply(batch, number) and after is not None:
            after(batch, number)

    table.folder.make()
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stop(query: StreamingQuery, seconds: float = 30) -> None:
    """Let the running batch end, then stop."""
    query.processAllAvailable() if query.isActive else None
    query.stop()
    query.awaitTermination(int(seconds))


def sessions_of_stream(stream: DataFrame, entity: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of a stream with a watermark: entity, start, end, events."""
    windowed = stream.withWatermark(time, late).groupBy(F.col(entity), F.session_window(time, gap).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("events")).select(entity, "w.start", "w.end", "events")
