import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lockstep.functions import order_stats as os_
from lockstep.operators import statistics as st

SCHEMA = ("observation_offset int, lockup_id long, ticker string, return_20d double, realized_vol_20d double, "
          "post_20d_return double, bearish_mfe_20d double, bearish_mae_20d double")
ARGS = ("return_20d", "realized_vol_20d", "post_20d_return")


def dataset(spark, triples):
    rows = [(-5, i + 1, f"T{i}", float(a), float(b), float(y), abs(y) / 2, abs(y) / 3) for i, (a, b, y) in enumerate(triples)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed,size,values", [(1, 31, 9), (2, 40, 1000), (3, 2, 5), (4, 1, 5), (5, 3000, 3)])
def test_medians_and_ranks_match_brute_force(spark, seed, size, values):
    rng = random.Random(seed)
    data = [("hot", rng.randint(-values, values) / 7) for _ in range(size)] + [("one", 3.25)]
    df = spark.createDataFrame(data, "k string, v double")
    hot = sorted(v for k, v in data if k == "hot")
    got = {r["k"]: r for r in os_.middle_values(df, ["k"], "v").collect()}
    assert got["hot"]["median"] == pytest.approx(statistics.median(hot)) and got["hot"]["n"] == size
    assert got["one"]["median"] == 3.25
    ranks = {r["v"]: r["r"] for r in os_.average_ranks(df, ["k"], "v", "r").where("k = 'hot'").collect()}
    for v in set(hot):
        places = [i + 1 for i, x in enumerate(hot) if x == v]
        assert ranks[v] == pytest.approx(sum(places) / len(places))


def test_ols_recovers_plane_and_influence_sums(spark):
    xs = [(1, 5), (2, 3), (3, 8), (4, 1), (5, 9), (6, 2)]
    rows = dataset(spark, [(a, b, 2 + 3 * a - 4 * b) for a, b in xs])
    fit = st.ols(rows, *ARGS).first()
    assert (fit["intercept"], fit["feature1_coefficient"], fit["feature2_coefficient"], fit["r_squared"]) == \
        pytest.approx((2, 3, -4, 1))
    noisy = dataset(spark, [(a, b, a - b + 0.3 * (-1) ** i) for i, (a, b) in enumerate(xs)])
    scored = st.influence(noisy, *ARGS).collect()
    assert sum(r["leverage"] for r in scored) == pytest.approx(3)
    ranked = [r["cooks_distance"] for r in st.ranked_influence(st.influence(noisy, *ARGS)).collect()]
    assert ranked == sorted(ranked, reverse=True)


@pytest.mark.parametrize("triples,status", [
    ([(1, i, i) for i in range(5)], "singular_design"), ([(i, 2 * i, i * i) for i in range(6)], "singular_design"),
    ([(1, 2, 3), (2, 1, 1), (5, 5, 2)], "insufficient_sample"), ([(i, i * i, 7) for i in range(5)], "constant_outcome")])
def test_ols_degenerate(spark, triples, status):
    assert st.ols(dataset(spark, triples), *ARGS).first()["status"] == status


def brute_force_cell(rows):
    m1, m2 = statistics.median(r[0] for r in rows), statistics.median(r[1] for r in rows)
    cell = [r[2] for r in rows if r[0] > m1 and r[1] > m2]
    return len(cell), statistics.median(cell) if cell else None, sum(cell) / len(cell) if cell else None


@pytest.mark.parametrize("seed,size", [(1, 12), (2, 13), (3, 5), (4, 30), (5, 31)])
def test_leave_one_out_matches_refitting(spark, seed, size):
    rng = random.Random(seed)
    # Coarse values force ties around both medians.
    triples = [(rng.randint(0, 6), rng.randint(0, 6) + rng.random() / 100, rng.gauss(0, 1)) for _ in range(size)]
    rows = dataset(spark, triples)
    runs = {r["excluded_lockup_id"]: r for r in st.leave_one_out(rows, *ARGS).collect()}
    assert len(runs) == size
    for i in range(size):
        left = triples[:i] + triples[i + 1:]
        n, median, mean = brute_force_cell(left)
        run = runs[i + 1]
        assert run["n_high_high"] == n
        assert (run["median_outcome"] is None) == (median is None)
        if n:
            assert run["median_outcome"] == pytest.approx(median) and run["mean_outcome"] == pytest.approx(mean)
        fit = st.ols(dataset(spark, left), *ARGS).first() if i < 2 else None
        if fit is not None:
            assert run["status"] == fit["status"]
            if fit["feature1_coefficient"] is not None:
                assert run["feature1_coefficient"] == pytest.approx(fit["feature1_coefficient"])
                assert run["r_squared"] == pytest.approx(fit["r_squared"])


def test_cells_keep_empty_ones(spark):
    rows = dataset(spark, [(1, 10, -.25), (2, 40, -.10), (3, 20, .05), (4, 30, -.05)])
    cells = {r["cell"]: r for r in st.interaction_cells(rows, *ARGS, -5).collect()}
    assert {k: r["n_events"] for k, r in cells.items()} == {"low_low": 1, "low_high": 1, "high_low": 1, "high_high": 1}
    few = {r["cell"]: r["n_events"] for r in st.interaction_cells(rows.where("lockup_id = 1"), *ARGS, -5).collect()}
    assert few == {"low_low": 1, "low_high": 0, "high_low": 0, "high_high": 0}


def test_spearman_and_p_value(spark):
    rng = random.Random(7)
    triples = [(i, 0, i + rng.gauss(0, 4)) for i in range(20)]
    row = st.spearman(dataset(spark, triples), ["observation_offset"], "return_20d", "post_20d_return").first()
    ys = sorted(t[2] for t in triples)
    d2 = sum((i - ys.index(t[2])) ** 2 for i, t in enumerate(triples))
    rho = 1 - 6 * d2 / (20 * (400 - 1))
    z = abs(rho) * math.sqrt(18 / (1 - rho * rho))
    assert row["spearman_rho"] == pytest.approx(rho) and row["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    flat = dataset(spark, [(1, 0, i) for i in range(5)])
    row = st.spearman(flat, ["observation_offset"], "return_20d", "post_20d_return").first()
    assert row["spearman_rho"] is None and row["p_value"] is None
    line = st.spearman(dataset(spark, [(i, 0, -i) for i in range(5)]), ["observation_offset"], "return_20d",
                       "post_20d_return").first()
    assert line["spearman_rho"] == pytest.approx(-1) and line["p_value"] == 0


def test_unknown_names_are_rejected(spark):
    with pytest.raises(ValueError, match="allowed pre-event feature"):
        st.check_names(["post_20d_return"], "post_20d_return")
    with pytest.raises(ValueError, match="allowed retrospective outcome"):
        st.check_names(["return_20d"], "return_20d")


def test_persistence(spark):
    paths = {1: (-1, -2, -1, -3), 2: (1, 1, 1, 1), 3: (-1, 1, 1, 2), 4: (1, -1, -1, -1), 5: (1, 0, 1, 1), 6: (1, 1, 1, None)}
    rows = [(o, k, v) for k, p in paths.items() for o, v in zip((-20, -10, -5, -1), p)]
    df = spark.createDataFrame([(o, k, None if v is None else float(v)) for o, k, v in rows],
                               "observation_offset int, lockup_id long, return_20d double")
    got = {r["lockup_id"]: r["category"] for r in st.signal_persistence(df, "return_20d").collect()}
    assert got == {1: "persistent_negative", 2: "persistent_positive", 3: "negative_then_reversed",
                   4: "positive_then_reversed", 5: "mixed"}


def test_close_values_do_not_share_one_bucket(spark):
    from pyspark.sql import functions as F

    from lockstep.functions.order_stats import BUCKETS, _bucketed, middle_values
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), (1.0 + F.col("id") / (n * 1000.0)).alias("v"))
    sizes = _bucketed(df, ["k"], "v").groupBy("_bucket").count().collect()
    assert len(sizes) > BUCKETS * 0.9 and max(r["count"] for r in sizes) < 4 * n / BUCKETS
    assert middle_values(df, ["k"], "v").first()["middle"] == 1.0 + (n // 2) / (n * 1000.0)


def test_positions_of_many_parts(spark):
    from lockstep.functions.total_order import with_position
    values = [(k * 7919 % 1009, f"t{k % 3}") for k in range(1009)]
    for parts in (1, 2, 5, 50, 101):
        got = with_position(spark.createDataFrame(values, "k long, t string"), [F.col("t"), F.col("k")], parts=parts).collect()
        assert [(r["t"], r["k"]) for r in sorted(got, key=lambda r: r["position"])] == sorted((t, k) for k, t in values)
        assert sorted(r["position"] for r in got) == list(range(1, 1010))
