"""Training control as a pure function of ordered evaluations: warmup, plateau, best, early stop."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTOR, PATIENCE, STOP_PATIENCE, MIN_GAIN = 0.5, 4, 10, 1e-4
COLUMNS = "is_best boolean, no_improve int, lr double, stopped boolean"


def warmup(base: float, step: Column, steps: int) -> Column:
    """base * (step + 1) / steps while step < steps, then base."""
    return F.when(step < steps, F.lit(base) * (step + 1) / F.lit(steps)).otherwise(F.lit(base))


@dataclass
class State:
    lr: float
    min_lr: float
    best: float = float("inf")
    no_improve: int = 0
    low: float = float("inf")
    bad: int = 0
    stopped: bool = False

    def feed(self, cer: float, is_full: bool = False, in_warmup: bool = False, early_stop: bool = True) -> bool:
        """Takes one evaluation; whether it is a new best. Full evaluations and those during warmup are
        only logged. The plateau compares relatively, the best absolutely."""
        if self.stopped or is_full or in_warmup:
            return False
        if cer < self.low * (1 - MIN_GAIN):
            self.low, self.bad = cer, 0
        else:
            self.bad += 1
            if self.bad > PATIENCE:
                lower = max(self.lr * FACTOR, self.min_lr)
                self.lr, self.bad = (lower if self.lr - lower > 1e-8 else self.lr), 0
        if cer < self.best - MIN_GAIN:
            self.best, self.no_improve = cer, 0
            return True
        self.no_improve += 1
        self.stopped = early_stop and self.lr <= 1.001 * self.min_lr and self.no_improve >= STOP_PATIENCE
        return False


def run_machine(df: DataFrame, run: str, step: str, cer: str, base_lr: float, warmup_steps: int = 0, full_every: int = 0) -> DataFrame:
    """``df`` (run, step, cer) with is_best, no_improve, lr, stopped after each evaluation in the order of
    steps. One run's evaluations (thousands at most) are one group; runs go in parallel. Null cer rows
    are left out."""
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        s, out = State(base_lr, base_lr / 64), []
        for at, c in zip(p["step"], p["cer"]):
            best = s.feed(float(c), bool(full_every and at % full_every == 0), at < warmup_steps)
            out.append((best, s.no_improve, s.lr, s.stopped))
        return pd.concat([p.reset_index(drop=True), pd.DataFrame(out, columns=["is_best", "no_improve", "lr", "stopped"])], axis=1)

    kind = dict(df.dtypes)[run]
    d = df.where(F.col(cer).isNotNull()).select(F.col(run).alias("run"), F.col(step).cast("bigint").alias("step"), F.col(cer).cast("double").alias("cer"))
    return d.groupBy("run").applyInPandas(lambda p: fold(p.sort_values(["step", "cer"])), f"run {kind}, step bigint, cer double, {COLUMNS}")
