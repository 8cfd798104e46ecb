"""Features of epochs that keep arriving: the batch plan, run on each new batch of files.

Epochs are complete rows, so no state is kept between batches and no watermark
is needed; the checkpoint of the query makes each file count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from signalloom.params import JobParams
from signalloom.plans.features import epochs_features_long

EPOCH_ROW_SCHEMA = T.StructType(
    [
        T.StructField("SubjectID", T.StringType()),
        T.StructField("EpochID", T.StringType()),
        T.StructField("Electrode", T.StringType()),
        T.StructField("signal", T.ArrayType(T.DoubleType())),
    ]
)


def read_arriving_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EPOCH_ROW_SCHEMA).parquet(path)


def write_arriving_features(
    epochs: DataFrame, params: JobParams, out: str, checkpoint: str
) -> StreamingQuery:
    """Process what has arrived and stop. One directory per batch, so a rerun replaces it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        long = epochs_features_long(batch, params)
        long.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        epochs.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
