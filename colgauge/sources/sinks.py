"""Writing splits, linked rows, extracts, history and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from colgauge.functions.scalars import col
from colgauge.operators.clean import FeatureSet
from colgauge.operators.guards import check_prepared
from colgauge.sources.tables import file_listing


def write_splits(df: DataFrame, features: FeatureSet, path: str, mapping: DataFrame | None = None) -> str:
    """Checks the prepared table, then writes one folder per split; nothing is written if a check fails."""
    failed = check_prepared(df, features).filter("status = 'FAIL'").collect()
    if failed:
        raise ValueError("; ".join(f"{r.check}: {r.detail}" for r in failed))
    df.write.mode("overwrite").partitionBy(features.split).parquet(path)
    if mapping is not None:
        mapping.write.mode("overwrite").csv(f"{path.rstrip('/')}_column_mapping", header=True)
    return path


def write_linked(linked: DataFrame, path: str, id_col: str = "id", partitions: int | None = None) -> str:
    """Linked rows clustered by id, so a reader of some ids opens few row groups."""
    clustered = linked.repartition(partitions, col(id_col)) if partitions else linked.repartition(col(id_col))
    clustered.sortWithinPartitions(id_col).write.mode("overwrite").parquet(path)
    return path


def extract_fingerprint(spark: SparkSession, source_path: str, ids: DataFrame, key: str) -> DataFrame:
    """One row that changes when the source's files, the keys asked for, or the key column do.

    Hashes are added up, so their order does not matter and no task sees them all.
    """
    files = file_listing(spark, source_path).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).cast("string").alias("files"),
    )
    keys = ids.select(col(key).cast("string").alias("k")).distinct().agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(F.xxhash64("k").cast("decimal(38,0)")).cast("string").alias("keys"),
    )
    return files.select(
        F.lit(key).alias("key"), "n_files", "n_bytes", "files",
        keys.select("n_keys").scalar().alias("n_keys"), keys.select("keys").scalar().alias("keys"),
    )


def extract_cut(source: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The source's rows whose key some id has."""
    return source.join(ids.select(col(key)), key, "left_semi")


def save_extract(
    spark: SparkSession, source: DataFrame, source_path: str, ids: DataFrame, key: str, path: str,
    max_share: float | None = None,
) -> bool:
    """Keeps the cut beside its fingerprint; with ``max_share`` False if it is a larger part of the source.

    The cut runs once; its rows are then counted from the files written.
    """
    extract_cut(source, ids, key).write.mode("overwrite").parquet(f"{path}/rows")
    if max_share is not None and spark.read.parquet(f"{path}/rows").count() > max_share * source.count():
        return False
    extract_fingerprint(spark, source_path, ids, key).write.mode("overwrite").parquet(f"{path}/fingerprint")
    return True


def load_extract(spark: SparkSession, source_path: str, ids: DataFrame, key: str, path: str) -> DataFrame | None:
    """The kept cut, or None when there is none or what it was made from has changed."""
    try:
        kept = spark.read.parquet(f"{path}/fingerprint").first()
    except AnalysisException:
        return None
    if kept is None or kept.asDict() != extract_fingerprint(spark, source_path, ids, key).first().asDict():
        return None
    return spark.read.parquet(f"{path}/rows")


def proposal_history(proposals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each proposal (run, round, feature, delta, error) with its outcome, the gate it fell at and why."""
    judged = verdicts.select("feature", "verdict", "failed_at", F.col("reason").alias("_why"))
    joined = proposals.join(judged, "feature", "left")
    error, passed = F.col("error"), F.col("verdict").isin("PASS", "IN")
    late = F.when(error.startswith("Dropped on the full splits"), "full splits").otherwise("screen")
    small = F.format_string("its screen change %+.4f is below the least asked for", F.col("delta").cast("double"))
    return joined.select(
        *proposals.columns,
        F.when(error.isNull() & F.coalesce(passed, F.lit(False)), "accepted").otherwise("rejected").alias("outcome"),
        F.when(error.isNotNull(), late).when(F.col("verdict").isNull(), "screen").when(passed, "")
        .otherwise(F.coalesce("failed_at", F.lit(""))).alias("failed_at"),
        F.when(error.isNotNull(), error).when(F.col("verdict").isNull(), small)
        .otherwise(F.coalesce("_why", F.lit(""))).alias("reason"),
    )


def append_history(proposals: DataFrame, verdicts: DataFrame, path: str) -> str:
    proposal_history(proposals, verdicts).write.mode("append").parquet(path)
    return path


def write_artifacts(tables: Mapping[str, DataFrame], folder: str, scores: Sequence[str] = ("predictions",)) -> dict[str, str]:
    """Result tables as csv, row-scale score tables as parquet."""
    written = {}
    for name, table in tables.items():
        written[name] = f"{folder.rstrip('/')}/{name}"
        if name in scores:
            table.write.mode("overwrite").parquet(written[name])
        else:
            table.write.mode("overwrite").csv(written[name], header=True)
    return written
