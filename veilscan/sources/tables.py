"""Readers and writers. All paths go through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text tables: key columns and the column that holds the text.
TEXT_TABLES = {"documents": (("doc_id",), "text"), "pages": (("page_id",), "html"), "conversations": (("conv_id", "turn"), "text")}


#: How the names of written tables begin.
SCRATCH = "veilscan-"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and backticks in it too."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *gone: str) -> list[Column]:
    """The columns of `df` but those named in `gone`, whatever their case, as Spark compares names."""
    lower = {g.lower() for g in gone}
    return [quoted(c) for c in df.columns if c.lower() not in lower]


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out evenly if its files give fewer tasks than there are cores, for work that costs more than the move; else as it is.

    Spark cuts a file into splits, but a row group isn't cut: of the splits of a few files, those that have rows are
    counted (from footers, no column is read). All splits tell how much there is: as many tasks, in whole rounds of
    the cores, get the rows.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    full = splits
    if 0 < len(df.inputFiles()) < cores <= splits:  # a stream's batch names no files
        full = df.select(F.spark_partition_id().alias("split")).distinct().count()
    return df.repartition(cores * max(1, -(-splits // cores))) if full < cores else df


def read_text_docs(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """(doc_id or the table's keys, text, and lang and source where the table has them); other columns are pruned."""
    keys, text = TEXT_TABLES[name]
    df = table(spark, folder, name)
    return df.select(*keys, F.col(text).alias("text"), *(c for c in ("lang", "source") if c in df.columns))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of every file below `path` that isn't empty (Spark lists no empty ones); content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_raw_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 64 << 20) -> DataFrame:
    """(path, modificationTime, length, content) of files that are read whole; larger ones are in `read_large_files`."""
    return list_files(spark, path, glob).filter(F.col("length") <= most_bytes)


def read_large_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 64 << 20) -> DataFrame:
    """(path, modificationTime, length) of the files above `most_bytes`, for `ranges.read_ranges`."""
    return list_files(spark, path, glob).filter(F.col("length") > most_bytes).select("path", "modificationTime", "length")


def list_parts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, parts) of every folder below `path` as one file, whose parts (path, start, length) are its files in order of their names."""
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), "struct<path:string,length:bigint>"
    files = list_files(spark, path, glob).select(folder.alias("folder"), F.struct("path", "length").cast(name).alias("part"))
    start = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1))["start"] + F.try_element_at(done, F.lit(-1))["length"], F.lit(0).cast("long"))
    placed = lambda done, x: F.concat(done, F.array(F.struct(x["path"].alias("path"), start(done).alias("start"), x["length"].alias("length"))))
    parts = F.aggregate(F.array_sort(F.collect_list("part")), F.array().cast("array<struct<path:string,start:bigint,length:bigint>>"), placed)
    return files.groupBy("folder").agg(parts.alias("parts"), F.sum("part.length").alias("length")).select(F.col("folder").alias("path"), "length", "parts")


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Exploded findings, a folder for each detector.

    A detector's rows are dealt to a few tasks by hash, so that not every task writes a file for each detector
    and a detector that makes most findings isn't one task.
    """
    parts = max(1, int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    salt = F.pmod(F.xxhash64("evidence_sha256", "ordinal"), F.lit(parts))
    findings.repartition("detector", salt).write.mode(mode).partitionBy("detector").parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temp folder only on local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-veilscan-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Spark then drops an execution's shuffle files when it ends, not when the driver happens to collect garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes that Spark hands to a Python worker at once, which it holds as well meanwhile.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """The session's settings as in `own`, and as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_path(spark: SparkSession) -> str:
    """A new name in the shared folder, which tells the application."""
    return f"{scratch_dir(spark)}/{SCRATCH}{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Parquet rather than checkpoint(): later readers prune columns, and it is compressed. The shuffle
    files behind it go at once, since nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    with settings(spark, {CLEAN: "true", BATCH: "4m"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Deletes the written tables of this application that `df` reads; for those that no later step reads."""
    spark, own = df.sparkSession, f"{SCRATCH}{df.sparkSession.sparkContext.applicationId}-"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith(own):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what this application wrote to the shared folder; call it when no result that reads it is in use."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{SCRATCH}{spark.sparkContext.applicationId}-*")) or []
    return sum(bool(fs.delete(x.getPath(), True)) for x in found)
