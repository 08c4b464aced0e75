"""W1 to W3: files and events as they arrive.

What a stream writes goes to a folder for each batch (`once`), which a rerun of the batch replaces: a query that fails
between its write and its commit leaves no repeated row.

Defined results: null texts, contents and kinds are kept as batch operators keep them; an event without a time is in no
window and isn't late; repeated rows count each, but W3 keeps one of them; where nothing arrives the tables are
empty; extra columns are ignored, but for W1 and W3, which keep them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.operators.scan import verdict_files
from veilscan.sources.tables import CLEAN, scratch_path, settings

RAW = "path string, modificationTime timestamp, length long, content binary"
#: The folders of a table that `once` writes.
BATCH = "arrival_batch_"


def arriving_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files as they arrive."""
    return spark.readStream.format("binaryFile").schema(RAW).option("pathGlobFilter", glob).load(folder)


def scan_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, glob: str = "*", most_bytes: int = 64 << 20) -> DataFrame:
    """W1: the table of verdicts (T1 to T7, B1 to B3) of all files that have arrived, those since the last call added: path, modificationTime, length and the columns of verdict."""
    return landed(arriving_files(spark, folder, glob), path, checkpoint, lambda files: verdict_files(files, most_bytes))


def read_arrivals(spark: SparkSession, folder: str, name: str = "events", files_at_once: int = 8) -> DataFrame:
    """A table as a stream, its time as a timestamp (Parquet's is without a zone, which watermarks reject)."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A file stream takes folders or patterns: this one has the table's name alone.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{folder}/{name}.parque[t]")
    return timed(stream)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in events.columns else events


def finding_rate(events: DataFrame, width: str = "1 day", kind: str = "event_type", late: str | None = "1 day") -> DataFrame:
    """W2: counts by window and kind; the same on a stream (state bounded by the watermark `late`) and on a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming and late else events
    counts = timed.groupBy(F.window("ts", width), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), kind, "n")


def closed_windows(stream: DataFrame, folder: str, width: str = "1 day", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """W2 with its late rows: start, kind, n and n_late of the windows that the watermark has closed, after all that has arrived on `stream`.

    Windows are counted with a watermark and leave the state, once, when it passes their end; n_late are the rows that
    came after that. They are what the arrivals of a window, counted batch by batch without state, have over n. Both
    counts go on from their checkpoints in `folder` when this is called again; files that arrive meanwhile
    are for the next call.
    """
    span = F.expr(f"INTERVAL {width}")
    total = landed(stream, f"{folder}/arrived", f"{folder}/arrived-state", lambda df: arrived(df, width, kind))
    counted = landed(finding_rate(stream, width, kind, late), f"{folder}/counted", f"{folder}/counted-state")
    total = total.groupBy("start", kind).agg(F.sum("n").alias("arrived"), F.max("last").alias("last"))
    reached = total.agg(F.date_trunc("millisecond", F.max("last")).alias("reached"))  # one row
    closed = total.crossJoin(F.broadcast(reached)).filter(F.col("start") + span <= F.col("reached") - F.expr(f"INTERVAL {late}"))
    counted = counted.select(F.col("start").alias("start_"), F.col(kind).alias("kind_"), "n")
    both = closed.join(counted, (F.col("start") == F.col("start_")) & F.col(kind).eqNullSafe(F.col("kind_")), "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return both.select("start", kind, n.alias("n"), (F.col("arrived") - n).alias("n_late"))


def arrived(events: DataFrame, width: str, kind: str) -> DataFrame:
    """A batch's counts by window and kind, and its latest times."""
    counts = events.groupBy(F.window("ts", width), kind).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return counts.select(F.col("window.start").alias("start"), kind, "n", "last")


def drop_repeat_arrivals(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """W3: the first arrival of each key; a key is forgotten when the watermark has passed its first arrival by `late`, and is first again then."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def once(path: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A sink that writes what `make` makes of a batch to the batch's own folder, in place of what an earlier try has left there."""

    def sink(df: DataFrame, batch: int) -> None:
        with settings(df.sparkSession, {CLEAN: "true"}):
            make(df).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")

    return sink


def landed(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The table at `path`, after everything that has arrived on `stream` has been written there, once, as `make` makes it."""
    spark = stream.sparkSession
    run_once(stream, once(path, make), checkpoint)
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*").drop(BATCH)
    except AnalysisException:  # nothing has arrived so far
        return make(spark.createDataFrame([], stream.schema))


def written(stream: DataFrame, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """`landed` in the shared folder."""
    return landed(stream, scratch_path(stream.sparkSession), scratch_path(stream.sparkSession), make)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that has arrived, then stop; a rerun takes up where the checkpoint left."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
