"""Scale and score a stream of samples.

Both steps look at one row at a time, so they hold no state and need no
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

from ..operators.scaling import scale
from ..plans.training import Model


def score_stream(samples: DataFrame, model: Model, stats: Row | None = None, method: str = "auto") -> DataFrame:
    """Scores of a streaming (label, features) table.

    ``stats`` is the fitted row of ``sample_stats(...).first()``; a stream cannot
    fit its own.
    """
    if not samples.isStreaming:
        raise ValueError("score_stream takes a streaming table; use Model.predict for others")
    return model.predict(samples if stats is None else scale(samples, stats), method)
