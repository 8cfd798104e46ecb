"""Explicit schemas of the tables the engine reads and writes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()

SUBJECT_SCHEMA = _struct(("SubjectID", _S, False), ("Group", _S, False))

PARTICIPANT_SCHEMA = _struct(("participant_id", _S, True), ("Group", _S, True))

SAMPLE_SCHEMA = _struct(
    ("SubjectID", _S, False), ("Electrode", _S, False), ("j", _L, False), ("value", _D, True)
)

RECORDING_SCHEMA = _struct(
    ("SubjectID", _S, False), ("SFreq", _D, False), ("n_samples", _L, False)
)

ANNOTATION_SCHEMA = _struct(
    ("SubjectID", _S, False),
    ("onset", _D, False),
    ("duration", _D, False),
    ("description", _S, True),
)

# One row per epoch, channels x time.
PACKED_EPOCH_SCHEMA = _struct(
    ("SubjectID", _S, False),
    ("EpochID", _S, False),
    ("EEG", T.ArrayType(T.ArrayType(_D)), True),
)

METADATA_SCHEMA = _struct(
    ("SubjectID", _S, False),
    ("ChannelNames", T.ArrayType(_S), True),
    ("SFreq", _D, True),
    ("NumEpochs", _L, True),
)

FEATURE_SCHEMA = _struct(
    ("SubjectID", _S, False),
    ("EpochID", _S, False),
    ("Electrode", _S, True),
    ("WaveBand", _S, True),
    ("FeatureName", _S, True),
    ("FeatureValue", _D, True),
    ("table_type", _S, True),
)

# All that a job yields, told apart by ``outcome``; columns an outcome lacks are null.
OUTCOME_SCHEMA = _struct(
    ("outcome", _S, False),
    ("SubjectID", _S, False),
    ("EpochID", _S, True),
    ("Electrode", _S, True),
    ("WaveBand", _S, True),
    ("FeatureName", _S, True),
    ("FeatureValue", _D, True),
    ("table_type", _S, True),
    ("reason", _S, True),
    ("ChannelNames", T.ArrayType(_S), True),
    ("SFreq", _D, True),
    ("NumEpochs", _L, True),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, by name, in its order and types; a missing one is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing from {df.columns}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
