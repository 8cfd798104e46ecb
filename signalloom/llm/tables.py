"""Written intermediate tables and small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.sources.scratch import scratch_path

# Characters that separate words and are stripped from line ends.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: lineage ends there.

    A lost executor then costs the reading of files, not the work before them.
    The table stays until the owner of ``spark.checkpoint.dir`` removes it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_prefix(columns: list[str]) -> str:
    """Underscores that none of ``columns`` begins with: names after it clash with none."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def wide_hash(*values: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, together a 128-bit key."""
    return F.xxhash64(*values), F.xxhash64(F.lit(0x5EED), *values)
