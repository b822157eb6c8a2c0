"""Descriptive statistics per observation offset; offsets are never pooled."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.constants import FROZEN, GROUPS, Hypothesis
from lockstep.functions.numeric import erfc, side, sign_name
from lockstep.functions.order_stats import average_ranks, loo_median, medians, middle_columns, middle_values
from lockstep.operators.dataset import FEATURES, OUTCOMES

OFFSET = "observation_offset"
CUTOFFS = (("le_5pct", -0.05), ("le_10pct", -0.10), ("le_20pct", -0.20))


def check_names(features, outcome: str) -> None:
    for name in features:
        if name not in FEATURES:
            raise ValueError(f"not an allowed pre-event feature: {name}")
    if outcome not in OUTCOMES:
        raise ValueError(f"not an allowed retrospective outcome: {outcome}")


def excursion_columns(outcome: str) -> tuple[str, str]:
    horizon = outcome.removeprefix("post_").removesuffix("_return")
    return f"bearish_mfe_{horizon}", f"bearish_mae_{horizon}"


def outcome_stats(outcome: str) -> list[Column]:
    """Mean, bearish hits and magnitude counts and rates of one outcome column."""
    y = F.col(outcome)
    n = F.count(y)
    hits = F.count_if(y < 0)
    out = [F.avg(y).alias("mean_outcome"), hits.alias("bearish_hit_count"),
           F.try_divide(hits, n).alias("bearish_hit_rate")]
    for label, cutoff in CUTOFFS:
        out += [F.count_if(y <= cutoff).alias(f"{label}_count"),
                F.try_divide(F.count_if(y <= cutoff), n).alias(f"{label}_rate")]
    return out


def group_summary(rows: DataFrame, keys: list[str], features: dict[str, str], outcome: str) -> DataFrame:
    """Events, observations, outcome statistics and exact medians per key."""
    totals = rows.groupBy(*keys).agg(
        F.count_distinct("lockup_id").alias("n_events"), F.count(F.lit(1)).alias("n_observations"),
        *outcome_stats(outcome))
    mfe, mae = excursion_columns(outcome)
    columns = {**features, outcome: "median_outcome"}
    for name, label in ((mfe, "median_bearish_mfe"), (mae, "median_bearish_mae")):
        if name in rows.columns:
            columns[name] = label
    return totals.join(medians(rows, keys, columns), keys, "left")


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation and its exploratory two-sided p-value per key.

    Null for fewer than three pairs or constant ranks.
    """
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ranked = average_ranks(average_ranks(pairs, keys, "_x", "_rx"), keys, "_y", "_ry")
    spread = F.stddev_pop("_rx") * F.stddev_pop("_ry")
    rho = F.when(F.count(F.lit(1)) >= 3, F.try_divide(F.covar_pop("_rx", "_ry"), spread))
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rho.alias("spearman_rho"))
    # least and greatest skip nulls, so an undefined correlation stays null explicitly.
    r = F.when(F.col("spearman_rho").isNotNull(),
               F.least(F.greatest(F.col("spearman_rho"), F.lit(-1.0)), F.lit(1.0)))
    z = F.abs(r) * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-15), 1 - r * r))
    # Rank sums are exact multiples of one half, so |rho| = 1 shows up within 1e-12.
    return out.withColumn("p_value", F.when(F.abs(r) >= 1 - 1e-12, F.lit(0.0))
                          .otherwise(erfc(z / F.lit(math.sqrt(2)))))


def feature_analysis(dataset: DataFrame, feature: str, outcome: str, offset: int | None = None) -> DataFrame:
    """One row per offset: counts, feature mean and median, outcome statistics, rank correlation."""
    check_names([feature], outcome)
    rows = dataset if offset is None else dataset.where(F.col(OFFSET) == offset)
    valid = rows.where(F.col(feature).isNotNull() & F.col(outcome).isNotNull())
    summary = group_summary(valid, [OFFSET], {feature: "feature_median"}, outcome)
    means = valid.groupBy(OFFSET).agg(F.avg(feature).alias("feature_mean"))
    present = rows.select(OFFSET).distinct()
    return (present.join(summary, OFFSET, "left").join(means, OFFSET, "left")
            .join(spearman(valid, [OFFSET], feature, outcome), OFFSET, "left"))


def median_split(dataset: DataFrame, feature: str, outcome: str) -> DataFrame:
    """Rows at or below the offset's median against rows above it."""
    check_names([feature], outcome)
    valid = dataset.where(F.col(feature).isNotNull() & F.col(outcome).isNotNull())
    # One row per offset.
    middle = F.broadcast(medians(valid, [OFFSET], {feature: "_median"}))
    split = valid.join(middle, OFFSET).withColumn("half", F.when(
        F.col(feature) <= F.col("_median"), "feature_lte_median").otherwise("feature_gt_median"))
    return group_summary(split, [OFFSET, "half"], {feature: "median_feature"}, outcome)


def complete_cases(dataset: DataFrame, feature1: str, feature2: str, outcome: str, offset: int) -> DataFrame:
    """Rows of one offset with both features and the outcome; one per event by construction."""
    check_names([feature1, feature2], outcome)
    return dataset.where((F.col(OFFSET) == offset) & F.col(feature1).isNotNull()
                         & F.col(feature2).isNotNull() & F.col(outcome).isNotNull())


def selection_counts(dataset: DataFrame, feature1: str, feature2: str, outcome: str, offset: int) -> DataFrame:
    valid = F.col(feature1).isNotNull() & F.col(feature2).isNotNull() & F.col(outcome).isNotNull()
    return dataset.where(F.col(OFFSET) == offset).agg(
        F.count(F.lit(1)).alias("n_input_rows"), F.count_if(valid).alias("n_valid_rows"),
        F.count_if(~valid).alias("n_excluded_missing"))


def interaction_cells(dataset: DataFrame, feature1: str, feature2: str, outcome: str, offset: int) -> DataFrame:
    """The four median cells of two features; empty cells stay."""
    rows = complete_cases(dataset, feature1, feature2, outcome, offset)
    middle = F.broadcast(medians(rows, [OFFSET], {feature1: "_m1", feature2: "_m2"}))  # one row
    cells = rows.join(middle, OFFSET).withColumn("cell", F.concat_ws(
        "_", side(F.col(feature1), F.col("_m1")), side(F.col(feature2), F.col("_m2"))))
    summary = group_summary(cells, ["cell"], {feature1: "feature1_median", feature2: "feature2_median"}, outcome)
    names = dataset.sparkSession.createDataFrame([(g,) for g in GROUPS], "cell string")
    counts = [c for c in summary.columns if c.startswith("n_") or c.endswith("_count")]
    return names.join(summary, "cell", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


# --------------------------------------------------------------- two-feature least squares
def _moments(rows: DataFrame, x1: str, x2: str, y: str) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(OFFSET).agg(
        n.alias("n"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
        (F.var_pop(x1) * n).alias("s11"), (F.var_pop(x2) * n).alias("s22"), (F.var_pop(y) * n).alias("syy"),
        (F.covar_pop(x1, x2) * n).alias("s12"), (F.covar_pop(x1, y) * n).alias("s1y"),
        (F.covar_pop(x2, y) * n).alias("s2y"), (F.min(x1) == F.max(x1)).alias("flat1"),
        (F.min(x2) == F.max(x2)).alias("flat2"), (F.min(y) == F.max(y)).alias("flaty"))


def _fit(c: dict[str, Column], flat1: Column, flat2: Column, flaty: Column) -> dict[str, Column]:
    """Least-squares columns from centred sums."""
    det = c["s11"] * c["s22"] - c["s12"] * c["s12"]
    scale = F.greatest(c["s11"] * c["s22"], c["s12"] * c["s12"])
    singular = flat1 | flat2 | (F.abs(det) <= F.lit(1e-12) * scale)
    ok = (c["n"] >= 4) & ~singular
    b1 = F.when(ok, F.try_divide(c["s1y"] * c["s22"] - c["s2y"] * c["s12"], det))
    b2 = F.when(ok, F.try_divide(c["s2y"] * c["s11"] - c["s1y"] * c["s12"], det))
    sse = F.greatest(c["syy"] - b1 * c["s1y"] - b2 * c["s2y"], F.lit(0.0))
    varied = ok & ~flaty
    return {
        "status": F.when(c["n"] < 4, "insufficient_sample").when(singular, "singular_design")
            .when(flaty, "constant_outcome").otherwise("ok"),
        "intercept": c["my"] - b1 * c["m1"] - b2 * c["m2"],
        "feature1_coefficient": b1, "feature2_coefficient": b2,
        "r_squared": F.when(varied, F.greatest(F.lit(0.0), 1 - F.try_divide(sse, c["syy"]))),
        "standardized_beta_feature1": F.when(varied, b1 * F.sqrt(F.try_divide(c["s11"], c["syy"]))),
        "standardized_beta_feature2": F.when(varied, b2 * F.sqrt(F.try_divide(c["s22"], c["syy"])))}


_SUMS = ("n", "m1", "m2", "my", "s11", "s22", "syy", "s12", "s1y", "s2y")


def ols(rows: DataFrame, feature1: str, feature2: str, outcome: str) -> DataFrame:
    """One aggregate pass, then a closed-form solve; one row per offset."""
    sums = _moments(rows, feature1, feature2, outcome)
    fit = sums.withColumns(_fit({k: F.col(k) for k in _SUMS}, F.col("flat1"), F.col("flat2"), F.col("flaty")))
    return fit.withColumns({
        "feature1_coefficient_sign": sign_name(F.col("feature1_coefficient")),
        "feature2_coefficient_sign": sign_name(F.col("feature2_coefficient"))})


FIT_COLUMNS = ("n", "status", "intercept", "feature1_coefficient", "feature2_coefficient",
               "feature1_coefficient_sign", "feature2_coefficient_sign", "r_squared",
               "standardized_beta_feature1", "standardized_beta_feature2")


def leave_one_out_fits(rows: DataFrame, feature1: str, feature2: str, outcome: str) -> DataFrame:
    """The fit without each event, by removing its share from the centred sums.

    Removing one row costs a rank-one correction, so all refits take one pass over
    the rows next to a one-row aggregate.
    """
    sums = F.broadcast(_moments(rows, feature1, feature2, outcome))  # one row per offset
    full = rows.join(sums, OFFSET)
    d1, d2, dy = F.col(feature1) - F.col("m1"), F.col(feature2) - F.col("m2"), F.col(outcome) - F.col("my")
    n, left = F.col("n"), F.col("n") - 1
    shrink = F.try_divide(n, left)

    def less(name, a, b):
        value = F.col(name) - shrink * a * b
        # What remains after cancelling equal magnitudes is rounding noise.
        return F.when(F.abs(value) <= F.lit(1e-13) * F.abs(F.col(name)), F.lit(0.0)).otherwise(value)

    c = {"n": left, "m1": F.col("m1") - F.try_divide(d1, left), "m2": F.col("m2") - F.try_divide(d2, left),
         "my": F.col("my") - F.try_divide(dy, left), "s11": less("s11", d1, d1), "s22": less("s22", d2, d2),
         "syy": less("syy", dy, dy), "s12": F.col("s12") - shrink * d1 * d2,
         "s1y": F.col("s1y") - shrink * d1 * dy, "s2y": F.col("s2y") - shrink * d2 * dy}
    fits = full.withColumns({f"_{k}": v for k, v in c.items()})
    now = {k: F.col(f"_{k}") for k in c}
    fit = _fit(now, now["s11"] <= 0, now["s22"] <= 0, now["syy"] <= 0)
    return fits.select(OFFSET, F.col("lockup_id").alias("excluded_lockup_id"), F.col("_n").alias("n"),
                       *[v.alias(k) for k, v in fit.items()])


def leave_one_out_cell(rows: DataFrame, feature1: str, feature2: str, outcome: str) -> DataFrame:
    """High/high cell without each event; medians and membership follow every exclusion.

    Removing one value leaves at most three different medians per feature, hence at
    most nine threshold pairs.  Each pair's cell is aggregated once and every run only
    corrects it for the excluded row.
    """
    mfe, mae = excursion_columns(outcome)
    x1, x2, y = F.col(feature1), F.col(feature2), F.col(outcome)
    base = rows.select(OFFSET, "lockup_id", x1.alias("x1"), x2.alias("x2"), y.alias("y"),
                       F.col(mfe).alias("mfe"), F.col(mae).alias("mae"))
    base = base.join(F.broadcast(middle_columns(base, [OFFSET], ["x1", "x2"])), OFFSET)  # one row per offset

    def threshold(name):
        parts = [F.col(f"{name}_{c}") for c in ("n", "below", "middle", "above")]
        return loo_median(*parts, F.col(name))

    def possible(name):
        n, below, middle, above = [F.col(f"{name}_{c}") for c in ("n", "below", "middle", "above")]
        odd = F.array((middle + above) / 2, (below + middle) / 2, (below + above) / 2)
        return F.array_distinct(F.filter(F.when(n % 2 == 1, odd).otherwise(F.array(middle, below)),
                                         lambda t: t.isNotNull()))

    base = base.withColumns({"t1": threshold("x1"), "t2": threshold("x2"),
                             "_p1": possible("x1"), "_p2": possible("x2")})
    members = (base.withColumn("c1", F.explode(F.filter("_p1", lambda t: F.col("x1") > t)))
               .withColumn("c2", F.explode(F.filter("_p2", lambda t: F.col("x2") > t)))
               .select(OFFSET, F.col("c1").alias("t1"), F.col("c2").alias("t2"), "y", "mfe", "mae"))
    key = [OFFSET, "t1", "t2"]
    cells = members.groupBy(*key).agg(
        F.count(F.lit(1)).alias("cn"), F.sum("y").alias("cy"), F.count_if(F.col("y") < 0).alias("chit"),
        *[F.count_if(F.col("y") <= cut).alias(f"c_{label}") for label, cut in CUTOFFS])
    # At most nine rows per offset.
    cells = F.broadcast(cells.join(middle_columns(members, key, ["y", "mfe", "mae"]), key, "left"))
    runs = base.drop(*[c for c in base.columns if c.startswith(("x1_", "x2_", "_p"))]).join(cells, key, "left")
    inside = (F.col("x1") > F.col("t1")) & (F.col("x2") > F.col("t2"))
    own = F.when(inside, 1).otherwise(0)
    n = F.coalesce("cn", F.lit(0)) - own

    def rate(count, test):
        return F.try_divide(F.col(count) - F.when(inside & test, 1).otherwise(0), n)

    def median_of(name):
        removed = inside & F.col(name).isNotNull()
        parts = [F.col(f"{name}_{c}") for c in ("n", "below", "middle", "above")]
        return F.when(removed, loo_median(*parts, F.col(name))).otherwise(F.col(f"{name}_median"))

    return runs.select(
        OFFSET, F.col("lockup_id").alias("excluded_lockup_id"), n.alias("n_high_high"),
        rate("chit", F.col("y") < 0).alias("bearish_hit_rate"),
        F.try_divide(F.col("cy") - F.when(inside, F.col("y")).otherwise(0.0), n).alias("mean_outcome"),
        F.when(n > 0, median_of("y")).alias("median_outcome"),
        *[rate(f"c_{label}", F.col("y") <= cut).alias(f"{label}_rate") for label, cut in CUTOFFS],
        F.when(n > 0, median_of("mfe")).alias("median_bearish_mfe"),
        F.when(n > 0, median_of("mae")).alias("median_bearish_mae"))


def leave_one_out(rows: DataFrame, feature1: str, feature2: str, outcome: str) -> DataFrame:
    """One run per excluded event: refit columns plus the high/high cell."""
    return leave_one_out_fits(rows, feature1, feature2, outcome).join(
        leave_one_out_cell(rows, feature1, feature2, outcome), [OFFSET, "excluded_lockup_id"])


RUN_FIELDS = ("feature1_coefficient", "feature2_coefficient", "standardized_beta_feature1",
              "standardized_beta_feature2", "r_squared")
CELL_FIELDS = ("n_high_high", "bearish_hit_rate", "mean_outcome", "median_outcome", "le_20pct_rate",
               "median_bearish_mfe", "median_bearish_mae")


def run_ranges(runs: DataFrame, full: DataFrame) -> DataFrame:
    """Min, max, median and mean of each run field, with sign flips against the full fit."""
    ok = F.col("status") == "ok"
    entries = [F.struct(F.lit(f).alias("field"), F.when(ok, F.col(f)).cast("double").alias("v")) for f in RUN_FIELDS]
    entries += [F.struct(F.lit(f).alias("field"),
                         (F.col(f) if f == "n_high_high" else F.when(F.col("n_high_high") > 0, F.col(f)))
                         .cast("double").alias("v")) for f in CELL_FIELDS]
    long = runs.select(OFFSET, F.explode(F.array(*entries)).alias("e")).select(OFFSET, "e.field", "e.v")
    reference = full.select(OFFSET, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("full_sample_value")) for f in RUN_FIELDS])).alias("e")) \
        .select(OFFSET, "e.field", "e.full_sample_value")
    long = long.join(F.broadcast(reference), [OFFSET, "field"], "left")  # five rows per offset
    flips = F.count_if(sign_name(F.col("v")) != sign_name(F.col("full_sample_value")))
    key = [OFFSET, "field"]
    ranges = long.groupBy(*key).agg(
        F.max("full_sample_value").alias("full_sample_value"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg("v").alias("mean"), flips.alias("_flips"))
    return ranges.join(middle_values(long, key, "v").select(*key, "median"), key, "left").select(
        *key, "full_sample_value", "min", "max", "median", "mean",
        F.when(F.col("field").isin("feature1_coefficient", "feature2_coefficient"), F.col("_flips"))
        .alias("sign_flip_count"))


def robustness_flags(runs: DataFrame, full: DataFrame) -> DataFrame:
    """Run counts, sign stability and the always-negative flag; one row per offset."""
    ok = F.col("status") == "ok"
    reference = F.broadcast(full.select(OFFSET, *[F.col(f).alias(f"_{f}") for f in RUN_FIELDS[:2]]))

    def stable(field):
        return F.count_if(ok & (sign_name(F.col(field)) != sign_name(F.col(f"_{field}")))) == 0

    negative = F.col("median_outcome").isNotNull() & (F.col("median_outcome") < 0)
    return runs.join(reference, OFFSET).groupBy(OFFSET).agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(ok).alias("successful_runs"),
        F.count_if(~ok).alias("failed_runs"), F.count_if(F.col("n_high_high") == 0).alias("empty_high_high_runs"),
        stable("feature1_coefficient").alias("feature1_sign_stable"),
        stable("feature2_coefficient").alias("feature2_sign_stable"),
        F.bool_and(F.coalesce(negative, F.lit(False))).alias("high_high_median_outcome_always_negative"),
        F.min(F.when(F.col("n_high_high") > 0, F.col("bearish_hit_rate"))).alias("high_high_bearish_hit_rate_min"))


def influence(rows: DataFrame, feature1: str, feature2: str, outcome: str) -> DataFrame:
    """Leverage, residuals and Cook's distance of every event (empty without a fit)."""
    fit = ols(rows, feature1, feature2, outcome).where("intercept is not null")
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    a, b = F.col(feature1) - F.col("m1"), F.col(feature2) - F.col("m2")
    raw = 1 / F.col("n") + (F.col("s22") * a * a - 2 * F.col("s12") * a * b + F.col("s11") * b * b) / det
    clamped = (F.when((raw > -1e-12) & (raw < 0), 0.0).when((raw > 1) & (raw < 1 + 1e-12), 1.0).otherwise(raw))
    predicted = (F.col("intercept") + F.col("feature1_coefficient") * F.col(feature1)
                 + F.col("feature2_coefficient") * F.col(feature2))
    one = fit.select(OFFSET, "n", "m1", "m2", "s11", "s22", "s12", "intercept",
                     "feature1_coefficient", "feature2_coefficient")
    scored = rows.join(F.broadcast(one), OFFSET).withColumns({  # one row per offset
        "leverage": clamped, "predicted_outcome": predicted, "actual_outcome": F.col(outcome).cast("double")})
    scored = scored.withColumn("residual", F.col("actual_outcome") - F.col("predicted_outcome"))
    error = scored.groupBy(OFFSET).agg((F.sum(F.col("residual") * F.col("residual"))
                                        / F.nullif(F.count(F.lit(1)) - 3, F.lit(0))).alias("_mse"))
    usable = (F.col("_mse") > 0) & (F.col("leverage") < 1)
    room = 1 - F.col("leverage")
    return scored.join(F.broadcast(error), OFFSET).select(
        OFFSET, "lockup_id", "ticker", "actual_outcome", "predicted_outcome", "residual", "leverage",
        F.when(usable, F.try_divide(F.col("residual"), F.sqrt(F.col("_mse") * room))).alias("standardized_residual"),
        F.when(usable, F.try_divide(F.col("residual") * F.col("residual"), 3 * F.col("_mse"))
               * F.col("leverage") / (room * room)).alias("cooks_distance"))


def ranked_influence(scored: DataFrame) -> DataFrame:
    """Cook's distance first; without any, absolute standardised residual then leverage."""
    return scored.orderBy(F.col("cooks_distance").desc_nulls_last(),
                          F.abs("standardized_residual").desc_nulls_last(), F.desc("leverage"), "lockup_id")


def top_influence(scored: DataFrame, n: int = 5) -> DataFrame:
    return ranked_influence(scored).limit(n)


def signal_persistence(dataset: DataFrame, feature: str, offsets=(-20, -10, -5, -1)) -> DataFrame:
    """Category of each complete sign path over the given offsets."""
    signs = [F.max(F.when(F.col(OFFSET) == o, F.signum(feature))).alias(f"s{i}") for i, o in enumerate(offsets)]
    paths = dataset.where(F.col(OFFSET).isin(*offsets)).groupBy("lockup_id").agg(*signs)
    names = [f"s{i}" for i in range(len(offsets))]
    low, high = F.least(*names), F.greatest(*names)
    earlier_low, earlier_high = F.least(*names[:-1]), F.greatest(*names[:-1])
    last = F.col(names[-1])
    return paths.dropna(subset=names).select("lockup_id", F.when(high < 0, "persistent_negative")
        .when(low > 0, "persistent_positive").when((last > 0) & (earlier_low < 0), "negative_then_reversed")
        .when((last < 0) & (earlier_high > 0), "positive_then_reversed").otherwise("mixed").alias("category"))


def with_hypothesis(rows: DataFrame, hypotheses: tuple[Hypothesis, ...] = (FROZEN,)) -> DataFrame:
    """Append ``hypothesis_id`` of the registered analysis with the same features, outcome and offset; null without one."""
    key = ["feature1", "feature2", "outcome", "observation_offset"]
    registry = frozen_hypothesis(rows.sparkSession, hypotheses).select(*key, "hypothesis_id")
    return rows.join(F.broadcast(registry), key, "left")  # a handful of registered rows


def frozen_hypothesis(spark, hypotheses: tuple[Hypothesis, ...] = (FROZEN,)) -> DataFrame:
    """The registry as rows, for lookups and metadata."""
    return spark.createDataFrame(
        [(h.hypothesis_id, h.feature1, h.feature2, h.outcome, h.observation_offset, h.feature1_threshold,
          h.feature2_threshold, h.cutoff, h.version, h.grouping_rule) for h in hypotheses],
        "hypothesis_id string, feature1 string, feature2 string, outcome string, observation_offset int, "
        "feature1_threshold double, feature2_threshold double, prospective_start_date date, "
        "analysis_version string, grouping_rule string")
