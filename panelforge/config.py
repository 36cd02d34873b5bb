"""Names of models and options, and checks of parameters."""

from __future__ import annotations

import math
from enum import StrEnum


class Model(StrEnum):
    LASSO = "lasso"
    GROUP = "group"  # groups given by the caller
    HCGL = "hcgl"  # groups by hierarchical clustering, penalty on rows
    FCGL = "fcgl"  # the same groups, penalty on (cluster, factor) blocks
    COOPERATIVE = "cooperative"
    UNILASSO = "unilasso"


class Dependence(StrEnum):
    PEARSON = "pearson"
    SPEARMAN = "spearman"
    GERBER = "gerber"


class Distance(StrEnum):
    LINEAR = "linear"
    ROOT = "root"
    ANGLE = "angle"


class Init(StrEnum):
    ZERO = "zero"
    FIRST = "x0"
    MEAN = "mean"
    VAR = "var"


class Gap(StrEnum):
    FFILL = "ffill"
    DEFLATED = "deflated_ffill"
    ZERO = "zero_fill"
    NAN = "nan_fill"  # by name only: as ZERO, which is what users get today
    NULL = "null_fill"  # a null where the input is missing


class Smoother(StrEnum):
    NONE = "none"
    HOLD = "hold"
    PARTITION_BONUS = "partition_bonus"
    SIMILARITY_EWMA = "similarity_ewma"


def span_decay(span: float) -> float:
    """Decay of a span of at least 1."""
    if not (isinstance(span, (int, float)) and math.isfinite(span) and span >= 1):
        raise ValueError(f"span must be finite and at least 1, not {span!r}")
    return 1 - 2 / (span + 1)


def valid_decay(decay: float) -> float:
    if not (math.isfinite(decay) and 0 <= decay < 1):
        raise ValueError(f"decay must be in [0, 1), not {decay!r}")
    return decay
