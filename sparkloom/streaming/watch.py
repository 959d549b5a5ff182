"""File events: source, filters, debounce in batch and streaming form, and re-indexing per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILE_EVENTS
from ..sources.files import EXTENSIONS, extension

# Event kinds, other watched extensions, folders at the root that are not watched.
KINDS = ("Create", "Modify", "Remove")
CONFIG_EXTENSIONS = ("toml", "json", "yaml", "yml", "md")
SKIPPED_ROOTS = ("target", "node_modules", "dist", "build", ".git", "out")


def of_kinds(events: DataFrame, kinds=KINDS) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds))


def watched(path: Column) -> Column:
    """Whether a path relative to the root is one to re-index on: source or configuration file, outside
    of build folders and of hidden ones."""
    roots = "|".join(r.replace(".", r"\.") for r in SKIPPED_ROOTS)
    return extension(path).isin(*EXTENSIONS, *CONFIG_EXTENSIONS) & ~path.rlike(rf"^(?:{roots})[/\\]") & ~path.rlike(r"(?:^|[/\\])\.[^./\\]")


def debounce(events: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """project, first_ts, last_ts, n_events and the distinct paths of every burst.

    A burst ends when no event of the project follows within the gap; two events exactly one gap
    apart are one burst. The same plan runs on a stream behind a watermark."""
    w = F.session_window("ts", gap)
    out = events.groupBy("project", w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.collect_set("path").alias("paths"), F.max("ts").alias("last_ts"))
    return out.select("project", F.col("w.start").alias("first_ts"), "last_ts", "n_events", F.array_sort("paths").alias("paths"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON event files (path, kind, ts[, project])."""
    raw = spark.readStream.schema(FILE_EVENTS + ", project string").json(folder)
    return raw.withColumn("project", F.coalesce("project", F.lit("default")))


def debounce_stream(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of an event stream. A burst is emitted once the watermark has passed its end."""
    kept = of_kinds(events).where(watched(F.col("path")))
    return debounce(kept.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), gap)


def debounce_timer(events: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """Bursts by processing time: a project's timer is reset by every event and fires after gap_ms of
    silence, when its set of paths is emitted and cleared. project, paths."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            paths = state.get[0]
            state.remove()
            yield pd.DataFrame({"project": [key[0]], "paths": [sorted(paths.split("\n"))]})
            return
        seen = set(state.get[0].split("\n")) if state.exists else set()
        for pdf in frames:
            seen.update(pdf["path"])
        state.update(("\n".join(sorted(seen)),))
        state.setTimeoutDuration(gap_ms)

    kept = of_kinds(events).where(watched(F.col("path")))
    return kept.groupBy("project").applyInPandasWithState(step, "project string, paths array<string>", "paths string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def on_burst(bursts: DataFrame, action, checkpoint: str, name: str = "reindex"):
    """Starts a query that calls action(batch of bursts, batch id) for every micro-batch with a burst.

    Batches may be repeated after a failure; the action gets the batch id to be idempotent by."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            action(batch, batch_id)

    return bursts.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run).start()


def on_burst_into(bursts: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends all bursts of the events so far to Parquet files in folder, and then ends."""
    return bursts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def drain(events: DataFrame, emitted_until) -> DataFrame:
    """Bursts of a batch of events that a stopped stream had not emitted: those that end after the time."""
    return debounce(events).where(F.col("last_ts") > F.lit(emitted_until))
