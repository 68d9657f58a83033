"""Sinks: content-addressed artifacts, immutable publication, canonical lines, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def artifacts(blobs: DataFrame, content: str, media_type: str | None = None) -> DataFrame:
    """``artifact_id, media_type, byte_length, content``: each content once, addressed by its hash."""
    media = F.col(media_type) if media_type else F.lit(None).cast("string")
    b = blobs.where(F.col(content).isNotNull()).select(F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("artifact_id"), media.alias("media_type"), F.octet_length(content).alias("byte_length"), F.col(content).alias("content"))
    return b.groupBy("artifact_id").agg(F.min("media_type").alias("media_type"), F.first("byte_length").alias("byte_length"), F.first("content").alias("content"))


def put(spark: SparkSession, store: str, new: DataFrame) -> None:
    """Append the artifacts that a store does not hold yet; putting twice changes nothing."""
    try:
        held = spark.read.parquet(store).select("artifact_id")
        new = new.join(held, "artifact_id", "left_anti")
    except AnalysisException:
        pass
    new.write.mode("append").parquet(store)


def corrupt(store: DataFrame) -> DataFrame:
    """Artifacts whose content no longer has their hash."""
    return store.where(F.col("artifact_id") != F.concat(F.lit("sha256:"), F.sha2("content", 256)))


class Differs(RuntimeError):
    pass


def publish(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Write a table once. A second publication must be equal, row for row; returns whether anything was written."""
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return True
    cols = sorted(old.columns)
    if cols != sorted(df.columns) or not old.select(*cols).exceptAll(df.select(*cols)).isEmpty() or not df.select(*cols).exceptAll(old.select(*cols)).isEmpty():
        raise Differs(f"{path} was published with other content")
    return False


def write_lines(lines: DataFrame, line: str, order: list[str], path: str, one_file: bool = False) -> None:
    """Write one line per row in order; a single file only where its bytes must be ordered as a whole."""
    ordered = lines.orderBy(*order)
    (ordered.coalesce(1) if one_file else ordered).select(line).write.mode("errorifexists").text(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """One parquet table per kind, each row with the hash of its content."""
    for kind, df in sorted(tables.items()):
        h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
        df.withColumn("row_hash", h).write.mode("errorifexists").parquet(f"{path}/{kind}")
