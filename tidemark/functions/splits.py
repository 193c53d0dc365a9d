"""Train, validation and holdout windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.times import time_literal


@dataclass(frozen=True)
class Windows:
    """Half-open windows ``[train, val) [val, holdout) [holdout, end)``."""

    train_start: str
    val_start: str
    holdout_start: str | None = None
    holdout_end: str | None = None

    def __post_init__(self) -> None:
        if self.val_start <= self.train_start:
            raise ValueError("val_start must be after train_start")
        if self.holdout_start is not None and self.holdout_start <= self.val_start:
            raise ValueError("holdout_start must be after val_start")
        if self.holdout_start is None and self.holdout_end is not None:
            raise ValueError("holdout_end needs holdout_start")


def window_name(ts: Column | str, windows: Windows) -> Column:
    """train, val, holdout or null; without a holdout the val window is open."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    train, val = time_literal(windows.train_start), time_literal(windows.val_start)
    name = F.when((ts >= train) & (ts < val), "train")
    if windows.holdout_start is None:
        return name.when(ts >= val, "val")
    holdout = time_literal(windows.holdout_start)
    return name.when((ts >= val) & (ts < holdout), "val").when(ts >= holdout, "holdout")


def like_split(cohort: Column | str, ts: Column | str, windows: Windows) -> Column:
    """Split of a like by its user's cohort; unseen users have no train split."""
    cohort = F.col(cohort) if isinstance(cohort, str) else cohort
    window = window_name(ts, windows)
    seen = F.when(window == "holdout", "holdout_seen_users").otherwise(window)
    unseen = F.when(window == "val", "val_unseen_users").when(window == "holdout", "holdout_unseen_users")
    return F.when(cohort == "trainval", seen).when(cohort == "unseen_eval", unseen)


def post_split_window(in_sample: Column, sample_hour: Column, created: Column, windows: Windows) -> Column:
    """Window of the sampled hour for sampled rows, of the creation time otherwise."""
    when = F.when(in_sample & sample_hour.isNotNull(), sample_hour).otherwise(created)
    return window_name(when, windows)


def window_of_split(split: Column | str) -> Column:
    """The post window that serves a like split."""
    split = F.col(split) if isinstance(split, str) else split
    return (
        F.when(split == "val_unseen_users", "val")
        .when(split.startswith("holdout"), "holdout")
        .otherwise(split)
    )
