"""CTC: greedy decoding and loss."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_ids(frames: Column) -> Column:
    """Index of the largest score of each frame (the first of equals)."""
    return F.transform(frames, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))


def collapse(ids: Column, blank: Column | int) -> Column:
    """Ids that are no blank and differ from the frame before (a blank between repeats keeps both)."""
    return F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(ids, i - 1))))


def log_softmax(scores: Column) -> Column:
    """Log-probabilities of one frame, shifted by the maximum."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp((x - top).cast("double")))
    return F.transform(scores, lambda x: (x - top).cast("double") - F.log(total))


def nll(log_probs: np.ndarray, target: list[int], blank: int) -> float:
    """Negative log-likelihood of a target over all alignments; 0 if there's none."""
    ext = np.full(2 * len(target) + 1, blank)
    ext[1::2] = target
    skip = np.zeros(len(ext), bool)
    skip[3::2] = ext[3::2] != ext[1:-2:2]
    t = len(log_probs)
    if not t:
        return 0.0
    a = np.full(len(ext), -np.inf)
    a[:2] = log_probs[0, ext[:2]]
    for i in range(1, t):
        one = np.concatenate([[-np.inf], a[:-1]])
        two = np.where(skip, np.concatenate([[-np.inf, -np.inf], a[:-2]])[: len(a)], -np.inf)
        a = np.logaddexp(np.logaddexp(a, one), two) + log_probs[i, ext]
    end = np.logaddexp(a[-1], a[-2]) if len(a) > 1 else a[-1]
    return float(-end) if np.isfinite(end) else 0.0


def loss(log_probs: Column, target: Column, blank: int) -> Column:
    """Aggregate: mean over rows of nll / target length (1 at least)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def row(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([nll(np.array([list(f) for f in a], float), list(b), blank) for a, b in zip(x, y)])

    return F.avg(row(log_probs, target) / F.greatest(F.size(target), F.lit(1)))
