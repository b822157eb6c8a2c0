"""Values that are part of the result contract."""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Calendar identity and horizon.
CALENDAR_ID = "XNYS"
CALENDAR_PROVIDER = "rules"
CALENDAR_VERSION = "1"
CALENDAR_START = dt.date(1990, 1, 1)
CALENDAR_END = dt.date(2035, 12, 31)

# Observation and outcome grids, lineage versions.
SNAPSHOT_OFFSETS = (-60, -40, -20, -10, -5, -1)
OUTCOME_OFFSETS = (0, 1, 5, 10, 20, 40)
STORED_BAR_VERSION = "1"
SESSION_VERSION = "2"
OUTCOME_VERSION = "1"
TRADING_DAYS_PER_YEAR = 252

# Parity tolerances.
PARITY_ATOL = 1e-9
PARITY_RTOL = 1e-7

# Prospective evaluation modes.
STRICT = "strict_prospective"
SHADOW = "shadow_prospective"
LEGACY_STRICT = "prospective"
LIFECYCLE = "lifecycle_tracking"
GROUPS = ("low_low", "low_high", "high_low", "high_high")


@dataclass(frozen=True)
class Hypothesis:
    """A frozen two-feature hypothesis; ``cutoff`` itself is still historical."""

    hypothesis_id: str
    feature1: str
    feature2: str
    outcome: str
    observation_offset: int
    feature1_threshold: float
    feature2_threshold: float
    cutoff: dt.date
    version: str = "m7_robustness_v1"
    grouping_rule: str = "median_split"


# The registered hypothesis.
FROZEN = Hypothesis(
    hypothesis_id="m7_return20_vol20_minus5_post20",
    feature1="return_20d",
    feature2="realized_vol_20d",
    outcome="post_20d_return",
    observation_offset=-5,
    feature1_threshold=0.0332778702,
    feature2_threshold=0.8446461455,
    cutoff=dt.date(2026, 8, 23),
)


@dataclass(frozen=True)
class Scorecard:
    """Evidence floor of the prospective evaluation."""

    evaluation_id: str
    target_group: str
    minimum_matured: int
    minimum_matured_target: int


SCORECARD = Scorecard("m9a_prospective_eval_v1", "high_high", 20, 5)
