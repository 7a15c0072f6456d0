"""Shared plumbing: scratch tables in the cluster's shared folder and global positions over sorted rows."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or by ``setCheckpointDir`` where that is unset.

    Without either a session whose executors are threads of the driver (tests) gets a temporary one; on a cluster
    there is no folder that executors are known to share, which is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/matchloom/{label}-{uuid.uuid4().hex}"


#: Tables whose rows are counted before are written in so many parts, and one more for each so many rows.
LEAST_PARTS, PART_ROWS = 8, 20_000


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the shared folder and read it back.

    A written table survives lost executors and is computed once, where ``checkpoint()`` computes its plan twice.
    Where ``rows``, the most that it can have, is told, small tables have few parts, however many the shuffle before
    them has: each file costs the executor some forks, and rounds write many.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df if rows is None else df.coalesce(LEAST_PARTS + rows // PART_ROWS)).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of queries that end in here go as they end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/matchloom/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Memos that live as long as a Python worker. Kernels without one of these free them, as stages share workers.
MEMOS: list[dict] = []


def forget() -> None:
    for memo in MEMOS:
        memo.clear()


@contextmanager
def uncollected():
    """Without the cyclic collector, which would walk through the memos again and again; what is made in here must
    have no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def slices(batches, text: str | None = None, rows: int = 1_000, size: int = 4 << 20):
    """Arrow batches in parts of at most ``rows`` rows and, where a column of texts is named, about ``size`` bytes of
    it (one longer text is a part), so that what a kernel makes of one stays small."""
    for batch in batches:
        lengths = None
        if text is not None:
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            if lengths is not None:
                n = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + n], dtype=np.int64), size, side="right")))
            yield batch.slice(at, n)
            at += n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, int]:
    """Add ``row_no``: gapless positions from 0 in the given total order, without a single-partition window. Other
    columns can have any names; one of that name is replaced.

    One range shuffle sorts the rows; each row's place in its partition comes from the row id of that task and
    is written down with it; the partitions' row counts (one number for each partition) give the offsets.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    row = F.struct(*[df[f"`{c}`"] for c in df.columns if c != "row_no"]).alias("row")
    kept = materialise(ranged.select(row, F.monotonically_increasing_id().alias("at")), label)
    part = F.shiftright("at", 33).alias("part")
    counts = sorted((r["part"], r["n"]) for r in kept.groupBy(part).agg(F.count("*").alias("n")).collect())
    total, offsets = 0, []
    for place, n in counts:
        offsets.append((place, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part long, start long"))  # a row for each partition
    placed = kept.select("row", "at", part).join(starts, "part")
    return placed.select("row.*", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("row_no")), total
