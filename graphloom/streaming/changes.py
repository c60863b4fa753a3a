"""Change streams: debouncing, classification and stateful upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def debounce(changes: DataFrame, gap: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """A row for each burst of changes to a path: bursts end after ``gap`` without any. Works
    on a batch and, with a watermark, on a stream."""
    if watermark:
        changes = changes.withWatermark("ts", watermark)
    return changes.groupBy("path", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.array_sort(F.collect_set("kind")).alias("kinds")).drop("s")


def debounce_capped(changes: DataFrame, gap: str, cap: str) -> DataFrame:
    """A row for each burst, which ends by a quiet gap or once it has lasted ``cap``: within a
    session of the gap, a fold over its times in order opens a new burst beyond the cap. For
    streams of unbounded sessions use ``Debouncer``."""
    s = changes.groupBy("path", F.session_window("ts", gap).alias("s")).agg(F.array_sort(F.collect_list("ts")).alias("t"))
    one = "struct<first:timestamp,last:timestamp,n:bigint>"
    fold = f"""aggregate(t, cast(array() as array<{one}>), (a, x) -> if(size(a) > 0 and x < element_at(a, -1).first + interval {cap},
        concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', x, 'n', element_at(a, -1).n + 1))), concat(a, array(named_struct('first', x, 'last', x, 'n', 1L)))))"""
    return s.select("path", F.inline(F.expr(fold))).select("path", "n", "first", "last")


class Debouncer(StatefulProcessor):
    """Bursts of a stream: state is the open burst of a path; it is emitted by a timer after
    the gap, or at once when it has lasted the cap."""

    def __init__(self, gap_ms: int, cap_ms: int):
        self.gap, self.cap = gap_ms, cap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long")

    def _row(self, key, burst) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "n": [burst[2]], "first": [pd.Timestamp(burst[0], unit="ms")], "last": [pd.Timestamp(burst[1], unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.open.get() if self.open.exists() else None
        times = sorted(int(t.timestamp() * 1000) for b in rows for t in b["ts"])
        for t in times:
            if now is not None and (t - now[1] >= self.gap or t - now[0] >= self.cap):
                yield self._row(key, now)
                now = None
            now = (t, t, 1) if now is None else (now[0], max(now[1], t), now[2] + 1)
        if now is not None:
            self.open.update(now)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(min(now[1] + self.gap, now[0] + self.cap))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            burst = self.open.get()
            self.open.clear()
            yield self._row(key, burst)

    def close(self) -> None:
        pass


def debounce_stream(changes: DataFrame, gap_ms: int, cap_ms: int, watermark: str) -> DataFrame:
    """Bursts of a stream of changes (path, ts) that end by gap or cap, in event time."""
    rows = changes.withWatermark("ts", watermark).groupBy("path")
    return rows.transformWithStateInPandas(Debouncer(gap_ms, cap_ms), "path string, n long, first timestamp, last timestamp", "Append", "EventTime")


#: Events that a source may hold before it counts as overflowed; fixed value.
BOUND = 65_536


def file_events(spark: SparkSession, folder: str, most_files: int = 1) -> DataFrame:
    """A stream of changes from files of events (path, kind, ts) that arrive in a folder;
    back-pressure by files for each trigger. Noise folders are dropped at the source."""
    rows = spark.readStream.schema("path string, kind string, ts timestamp").option("maxFilesPerTrigger", most_files).json(folder)
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in NOISE])))


#: Folders whose changes say nothing; fixed values.
NOISE = ("target", ".git", "node_modules")


def classify(changes: DataFrame, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """The last state of each path, in small letters: modified or removed; paths in noise
    folders are dropped."""
    kept = changes.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in noise])))
    last = kept.groupBy(F.lower("path").alias("path")).agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"))
    return last.select("path", F.when(F.col("kind") == "removed", "removed").otherwise("modified").alias("state"))


def upsert(current: DataFrame, changed: DataFrame, states: DataFrame) -> DataFrame:
    """The relation after a batch: rows of touched paths go, those of modified paths come back."""
    kept = current.join(states.select("path"), "path", "left_anti")
    return kept.unionByName(changed.join(states.where("state = 'modified'").select("path"), "path", "left_semi").select(*current.columns))


def run_incremental(changes: DataFrame, read_changed, read_all, table_path: str, checkpoint: str, bound: int = BOUND, buckets: int = 64):
    """Structured Streaming: the table is kept in buckets of its paths, and a micro-batch writes
    only the buckets that it touches, as files of its own version; a manifest of the newest
    version of each bucket is written last and makes the batch visible at once. A batch that
    is retried finds its manifest and does nothing. A batch of over ``bound`` events stands for
    lost ones: everything is read afresh with ``read_all``."""

    def bucket() -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        version = number + 1
        if _manifest(spark, table_path, version) is not None:
            return
        known = _manifest(spark, table_path, number) or {}
        target = f"{table_path}/v={version}"
        if rows.count() > bound:
            fresh = read_all(spark)
            touched = list(range(buckets))
        else:
            states = classify(rows).persist()
            touched = sorted(r.b for r in states.select(bucket().alias("b")).distinct().collect())  # at most the buckets
            fresh = upsert(_read(spark, table_path, {b: known[b] for b in touched if b in known}, read_changed(spark, states)), read_changed(spark, states), states)
        fresh.withColumn("bucket", bucket()).write.mode("overwrite").partitionBy("bucket").parquet(target)
        now = known | dict.fromkeys(touched, version)
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{table_path}/manifest/v={version}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def _manifest(spark: SparkSession, table_path: str, version: int) -> dict[int, int] | None:
    """Newest version of each bucket, if that version was completed."""
    try:
        return {r.bucket: r.version for r in spark.read.parquet(f"{table_path}/manifest/v={version}").collect()}
    except AnalysisException:
        return None


def _read(spark: SparkSession, table_path: str, known: dict[int, int], like: DataFrame) -> DataFrame:
    paths = [f"{table_path}/v={v}/bucket={b}" for b, v in sorted(known.items())]
    out = like.limit(0)
    for p in paths:
        try:
            out = out.unionByName(spark.read.parquet(p).select(*like.columns))
        except AnalysisException:
            continue  # a bucket without rows has no files
    return out


def published(spark: SparkSession, table_path: str, version: int, like: DataFrame) -> DataFrame:
    """The table as of a completed version."""
    return _read(spark, table_path, _manifest(spark, table_path, version) or {}, like)
