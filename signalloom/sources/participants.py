"""The participants file: who was recorded, and in which study group."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.params import JobParams
from signalloom.schemas import PARTICIPANT_SCHEMA, SUBJECT_SCHEMA, conform

# The study groups kept, in label order, and the folder of the public data set.
GROUPS = ("A", "C", "F")
DATASET = "ds004504"


def participants_path(params: JobParams, dataset: str = DATASET) -> str:
    return posixpath.join(params.data_path, dataset, "participants.tsv")


def select_subjects(participants: DataFrame) -> DataFrame:
    """Subjects of the known groups; other and missing groups are dropped, duplicates kept."""
    known = conform(participants, PARTICIPANT_SCHEMA).where(F.col("Group").isin(*GROUPS))
    return conform(known.withColumnRenamed("participant_id", "SubjectID"), SUBJECT_SCHEMA)


def read_subjects(spark: SparkSession, params: JobParams, path: str = "") -> DataFrame:
    """Columns are taken by name from the header, whatever else the file holds."""
    raw = spark.read.csv(path or participants_path(params), sep="\t", header=True)
    return select_subjects(raw)


def group_label(group) -> F.Column:
    """Integer class label of a study group: its position in ``GROUPS``."""
    return (F.array_position(F.array(*[F.lit(g) for g in GROUPS]), group) - 1).cast("int")
