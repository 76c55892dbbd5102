"""Reading tables and event sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from colgauge.functions.scalars import col

# File suffixes and the format each stands for.
SUFFIXES = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".gz": "csv", ".txt": "csv"}
SPLITS = ("train", "valid", "test")


def table_format(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = "." + name.rsplit(".", 1)[-1] if "." in name else ""
    return SUFFIXES.get(suffix, "parquet" if not suffix else "csv")


def read_table(spark: SparkSession, path: str, format: str = "auto", schema: StructType | str | None = None) -> DataFrame:
    """A parquet or csv table, by its suffix unless told; a folder without one is parquet.

    A csv has a header; give its ``schema``, as types are read as text otherwise.
    """
    kind = table_format(path) if format == "auto" else format
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        if kind == "parquet":
            return reader.parquet(path)
        if kind == "csv":
            return reader.csv(path, header=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(
                f"data file does not exist: {path}; paths are read as the cluster sees them"
            ) from error
        raise
    raise ValueError(f"format must be auto, parquet or csv, got {format!r}")


scan_source = read_table


def read_headerless(
    spark: SparkSession, path: str, names: Sequence[str], null_value: str = "?", schema: str | None = None
) -> DataFrame:
    """A csv whose column names come separately; their number must match."""
    df = spark.read.csv(path, header=False, nullValue=null_value)
    if len(df.columns) != len(names):
        raise ValueError(f"{path} has {len(df.columns)} columns, {len(names)} names were given")
    if schema:
        return spark.read.schema(schema).csv(path, header=False, nullValue=null_value).toDF(*names)
    return df.toDF(*names)


def peek(source: DataFrame, n: int = 200_000) -> DataFrame:
    """The first rows of a source, for looking at keys and formats."""
    return source.limit(n)


def row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(source, n_rows, n_bytes) per source; counts come from file footers, sizes from the listing."""
    out = None
    for name, path in paths.items():
        counted = read_table(spark, path).agg(F.count(F.lit(1)).alias("n_rows"))
        size = file_listing(spark, path).agg(F.sum("length")).scalar()
        one = counted.select(F.lit(name).alias("source"), "n_rows", size.alias("n_bytes"))
        out = one if out is None else out.unionByName(one)
    return out


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of a table's files; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "length", "modificationTime"
    )


def assert_columns(df: DataFrame, columns: Sequence[str], what: str = "the table") -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"{what} is missing columns {absent}")
    return df


def from_frames(frames: Mapping[str, DataFrame], target: str, split: str = "split") -> DataFrame:
    """Split tables as one, with a ``split`` column; the rows stay in the split given.

    Every split needs train's columns and the target.
    """
    unknown = sorted(set(frames) - set(SPLITS))
    if unknown:
        raise ValueError(f"splits must be train, valid or test, got {unknown}")
    if "train" not in frames or frames["train"].isEmpty():
        raise ValueError("a non-empty train split is required")
    columns = frames["train"].columns
    out = None
    for name in (s for s in SPLITS if s in frames):
        assert_columns(frames[name], [target, *columns], f"the {name!r} split")
        part = frames[name].select(*[col(c) for c in columns]).withColumn(split, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def load_splits(spark: SparkSession, paths: Mapping[str, str], target: str, format: str = "auto") -> DataFrame:
    return from_frames({name: read_table(spark, path, format) for name, path in paths.items()}, target)
