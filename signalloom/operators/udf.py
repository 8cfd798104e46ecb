"""The hook for a user's own per-epoch features in pandas. The engine itself does not use it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def apply_epoch_features(
    epochs: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    keys: Sequence[str] = ("SubjectID", "EpochID"),
) -> DataFrame:
    """Call ``fn`` on the channel rows of one epoch at a time.

    Groups are single epochs, never whole subjects, so their size does not grow
    with the data. ``fn`` may return an empty frame.
    """
    return epochs.groupBy(*keys).applyInPandas(fn, schema=schema)


def map_packed_epochs(
    packed: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Call ``fn`` on Arrow batches of packed epochs (one row each); nothing is shuffled."""

    def each(batches):
        for batch in batches:
            yield fn(batch)

    return packed.mapInPandas(each, schema=schema)
