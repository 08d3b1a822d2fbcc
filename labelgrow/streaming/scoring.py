"""Arriving rows scored with a frozen model: cleaning, scoring and the confidence test keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.columns import sanitize_array
from ..operators.sampling import confident
from ..plans.models import Fitted


def score_stream(rows: DataFrame, model: Fitted, hi: float = 0.9, lo: float = 0.1) -> DataFrame:
    """Rows (id, features) of a stream or a table with ``prob``, ``pred`` and ``pseudo_label``."""
    return confident(model.score(sanitize_array(rows)), "prob", hi, lo)
