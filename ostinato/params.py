"""Parameters with the defaults of the detector and the clip planner, checked before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SAMPLE_RATE = 32_000
FRAMES_PER_SECOND = 100
SCALE_DETECT = 32_768.0
SCALE_RESCAN = 32_767.0


@dataclass(frozen=True)
class Detection:
    precision: int = 100
    block_size: int = 600
    threshold: float = 0.90
    focus_idx: int = 58
    classes: int = 527

    def __post_init__(self):
        if self.precision < 1 or self.block_size < 1:
            raise ValueError("precision and block_size must be at least 1")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be within 0 and 1")
        if not 0 <= self.focus_idx < self.classes:
            raise ValueError("focus_idx must be a class")


def valid_detection(precision: Column, block_size: Column, threshold: Column, focus_idx: Column, classes: int = 527) -> Column:
    """The same for rows of parameters, which may also be 0; nulls aren't valid."""
    return F.coalesce((precision >= 0) & (block_size >= 0) & (threshold >= 0) & (threshold <= 1) & (focus_idx >= 0) & (focus_idx < classes), F.lit(False))


def valid_interval(start_s: Column, end_s: Column, before: Column, after: Column) -> Column:
    """An interval that isn't empty and begins at 0 or later, with paddings that aren't negative; nulls aren't valid."""
    return F.coalesce((start_s >= 0) & (end_s > start_s) & (before >= 0) & (after >= 0), F.lit(False))


@dataclass(frozen=True)
class Planning:
    merge_gap: float = 2.0
    min_clip: float = 1.0
    tail_guard: float = 0.5
    before: float = 0.0
    after: float = 0.0

    def __post_init__(self):
        if min(self.before, self.after, self.merge_gap, self.min_clip, self.tail_guard) < 0:
            raise ValueError("paddings, gaps and lengths must not be negative")


@dataclass(frozen=True)
class Rescan:
    window: float = 5.0
    block: int = 10
    direct_accept: float = 0.75
    coalesce_gap: float = 1.0
    merge_gap: float = 2.0
    min_length: float = 0.5
    quiet_rms: float = 0.005
    target_rms: float = 0.25
    max_gain: float = 2.5
    tail: float = 0.1
