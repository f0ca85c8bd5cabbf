"""Hand-made rows for the null / absent-column / tie / boundary cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from leaserisk.functions import tiers as TI
from leaserisk.operators import features as FE
from leaserisk.operators import filters as P
from leaserisk.operators import prep as PP
from leaserisk.operators import reports as R
from leaserisk.operators import retention as RT
from leaserisk.operators import scoring as S
from leaserisk.operators import semantic as SM
from leaserisk.operators import validation as V
from leaserisk.operators import warehouse as WH

AS_OF = dt.date(1999, 1, 1)


def test_single_payment_std_is_null_and_consistency_one(spark):
    pay = spark.createDataFrame([(1, dt.date(1998, 5, 1), 100.0, 3, 0.0),
                                 (2, dt.date(1998, 5, 1), 50.0, 0, 0.0),
                                 (2, dt.date(1998, 6, 1), 70.0, 8, 50.0)],
                                "lease_id long, payment_date date, amount double, days_late int, late_fee double")
    agg = {r.lease_id: r for r in FE.payment_aggregates(pay).collect()}
    assert agg[1].payment_std is None
    assert agg[2].total_paid == 120.0 and agg[2].avg_payment == 60.0
    leases = spark.createDataFrame([(1,), (2,), (3,)], "lease_id long")
    merged = leases.join(FE.payment_aggregates(pay), "lease_id", "left")
    fm = {r.lease_id: r for r in FE.feature_matrix(merged, AS_OF, keys=("lease_id",)).collect()}
    assert fm[1].payment_consistency == 1.0
    assert fm[3].avg_days_late == 0.0 and fm[3].late_payment_rate == 0.0  # no payments
    assert fm[2].late_payment_rate == 4.0  # mean days late, kept as in the reference


def test_absent_columns_take_defaults(spark):
    df = spark.createDataFrame([(1,)], "lease_id long")
    r = FE.feature_matrix(df, AS_OF, keys=("lease_id",)).first()
    assert r.square_feet == 1500 and r.bedrooms == 3 and r.property_age == 1999 - 2000
    assert r.neighborhood_type == "suburban" and r.payment_method == "ach"
    assert r.years_since_renovation == 10 and r.days_to_expiration == 90 and r.lease_end_month == 1
    assert r.rent_to_income_ratio == 0.30 and r.market_rent_median == 2000
    assert len(FE.feature_catalog()) == 49 == len(set(f for f, _ in FE.feature_catalog()))


def test_null_income_ratio_stays_null(spark):
    df = spark.createDataFrame([(1, 2000.0, None), (2, 3000.0, 10000.0)],
                               "lease_id long, monthly_rent double, annual_income double")
    rows = {r.lease_id: r.rent_to_income_ratio for r in
            FE.feature_matrix(df, AS_OF, keys=("lease_id",)).collect()}
    assert rows[1] is None and rows[2] == 1.0


def test_rule_score_boundaries_and_levels(spark):
    # base 30 + no autopay 10 + complaints 15 + condition 10 + rent above market 15 = 80
    rows = [(1, False, 2, 2, 10, 250000, 2000.0, 400, 5),
            (2, True, 0, 4, 10, 200000, 2000.0, 400, 5),      # 30
            (3, False, 0, 4, 10, 200000, 2000.0, 100, 5)]     # 30 + 10 + 10 = 50
    df = spark.createDataFrame(rows, "lease_id long, autopay_enabled boolean, complaint_count int, "
                                     "condition_rating int, property_age int, rent_cents long, "
                                     "market_rent_median double, tenure_days int, vacancy_pct int")
    out = {r.lease_id: r for r in S.with_rule_risk(df).collect()}
    assert (out[1].risk_score, out[1].risk_level) == (80, "HIGH")
    assert (out[2].risk_score, out[2].risk_level) == (30, "LOW")
    assert (out[3].risk_score, out[3].risk_level, out[3].predicted_churn) == (50, "MEDIUM", True)
    assert out[3].confidence == 0.0


def test_probability_to_score_truncates(spark):
    r = spark.range(1).select(S.score_from_probability(F.lit(0.29)).alias("s")).first()
    assert r.s == 28


def test_incentive_thresholds(spark):
    df = spark.createDataFrame([(1, 70, 200000), (2, 69, 200000), (3, 60, 200000), (4, 59, 200000)],
                               "lease_id long, risk_score int, rent_cents long")
    out = {r.lease_id: (r.incentive_type, r.incentive_value) for r in RT.incentive_offer(df).collect()}
    assert out[1] == ("rent-discount", 100.0)
    assert out[2] == ("upgrade", 500.0) and out[3] == ("upgrade", 500.0)
    assert out[4] == ("gift-card", 250.0)


def test_renewal_window_bounds(spark):
    ends = [AS_OF, AS_OF + dt.timedelta(days=1), AS_OF + dt.timedelta(days=90), AS_OF + dt.timedelta(days=91)]
    df = spark.createDataFrame([(i, e, "active") for i, e in enumerate(ends)],
                               "lease_id long, end_date date, status string")
    got = sorted(r.lease_id for r in df.filter(P.renewal_window(AS_OF, 90)).collect())
    assert got == [1, 2]
    got = sorted(r.lease_id for r in df.filter(P.expiring_within(AS_OF, 90)).collect())
    assert got == [0, 1, 2]


def test_market_as_of_picks_latest_not_after(spark):
    m = spark.createDataFrame(
        [("7", dt.date(1998, 11, 1), 1000.0), ("7", dt.date(1999, 1, 1), 1100.0), ("7", dt.date(1999, 2, 1), 1200.0)],
        "zip_code string, data_date date, market_rent_median double")
    full = m
    for c in FE.MARKET_COLS:
        if c not in full.columns:
            full = full.withColumn(c, F.lit(None).cast("double"))
    r = FE.market_as_of(full, AS_OF).first()
    assert r.data_date == dt.date(1999, 1, 1) and r.market_rent_median == 1100.0


def test_label_encoder_unseen_and_absent(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    rows = spark.createDataFrame([(1, "b"), (2, "z"), (3, None)], "id long, c string")
    out = {r.id: (r.c_idx, r.d_idx) for r in PP.label_encode_plan(fit, rows, ["c", "d"]).collect()}
    assert out == {1: (1, -1), 2: (-1, -1), 3: (-1, -1)}
    state = PP.fit_label_encoder(fit, ["c", "d"])
    out2 = {r.id: r.c_idx for r in PP.apply_label_encoder(rows, state).collect()}
    assert out2 == {1: 1, 2: -1, 3: -1}


def test_scaling_constant_and_two_valued(spark):
    df = spark.createDataFrame([(1, 5.0, 0, 1.0), (2, 5.0, 1, 2.0), (3, 5.0, 1, 3.0)],
                               "id long, const double, flag int, x double")
    scaled = {r.id: r for r in PP.scale_plan(df, ["const", "x"]).collect()}
    assert all(scaled[i].const == 0.0 for i in (1, 2, 3))
    assert abs(scaled[3].x - 1.224744871391589) < 1e-12  # population std
    flags = {r.column_name: r.scale for r in PP.scale_columns_plan(df, ["const", "flag", "x"]).collect()}
    assert flags == {"const": False, "flag": False, "x": True}


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("cash", 1.0), ("ach", None), ("cash", 3.0), ("ach", 4.0)], "m string, v double")
    _, stats = PP.impute_plan(df, ["v"], ["m"])
    r = stats.first()
    assert r.mode_m == "ach" and r.median_v == 3.0
    filled = PP.impute_plan(df, ["v"], ["m"])[0]
    assert filled.filter(F.col("v").isNull()).count() == 0


def test_zero_active_leases_and_zero_campaigns(spark):
    empty = spark.createDataFrame([], "lease_id long, status string, risk_level string")
    r = R.risk_summary(empty, extended=True).first()
    assert r.total_active == 0 and r.high_risk_pct == 0.0 and r.medium_risk_pct == 0.0
    acts = spark.createDataFrame([], "action_id long, lease_id long, renewal_status string, triggered_at timestamp, "
                                     "action_type string")
    lr = spark.createDataFrame([], "lease_id long, risk_level string")
    m = RT.campaign_metrics(acts, lr)
    roi = RT.roi(m).first()
    assert roi.total_campaigns == 0 and roi.roi_percentage == 0.0 and roi.campaign_costs == 0


def test_campaign_modes(spark):
    ts = lambda s: dt.datetime.fromisoformat(s)
    acts = spark.createDataFrame([(1, 10, ts("2024-01-05 00:00:00")), (2, 10, ts("2024-01-25 00:00:00")),
                                  (3, 11, ts("2024-01-25 00:00:00"))],
                                 "action_id long, lease_id long, triggered_at timestamp")
    a = RT.campaign_actions(acts, "2024-01-10 00:00:00", "2024-01-20 00:00:00", "action")
    d = RT.campaign_actions(acts, "2024-01-10 00:00:00", "2024-01-20 00:00:00", "document")
    assert a.count() == 0
    # lease 10 has an action after start and one before end -> both counted (Q13)
    assert sorted(r.action_id for r in d.collect()) == [1, 2]


def test_latest_of_two_outcomes(spark):
    preds = spark.createDataFrame([(1, 5, 9, dt.date(1998, 12, 1))],
                                  "lease_id long, tenant_id long, property_id long, prediction_date date")
    tdim = spark.createDataFrame([(5, 40, "<50k", "standard", True)],
                                 "tenant_id long, age int, income_bracket string, tenant_segment string, "
                                 "is_current boolean")
    pdim = spark.createDataFrame([(9, "3", 20, 2, "<1200")],
                                 "property_id long, zip_code string, property_age int, amenity_score int, "
                                 "sqft_range string")
    mkt = spark.createDataFrame([("3", dt.date(1998, 12, 1), 0.05, 2000.0)],
                                "zip_code string, data_date date, vacancy_rate double, market_rent_median double")
    ev = spark.createDataFrame([(1, "RENEWAL", dt.date(1998, 1, 1)), (1, "EXPIRATION", dt.date(1999, 1, 1))],
                               "lease_id long, event_type string, event_date date")
    r = WH.training_view(preds, tdim, pdim, mkt, ev).first()
    assert r.outcome_type == "EXPIRATION" and r.churned == 1 and r.training_set
    assert r.vacancy_rate == 0.05


def test_tier_labels():
    assert TI.labels([30, 60, 90, 120]) == ["Below 30", "30 to 59", "60 to 89", "90 to 119", "120 or Above"]


def test_validation_counts_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (2, -1.0)], "k long, v double")
    out = {r.rule: r.violations for r in V.validate(df, [("v_pos", "v > 0")], unique=["k"]).collect()}
    assert out == {"v_pos": 2, "unique_k": 2}


def test_js_falsy_defaults(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 5)], "id long, x int")
    null_only = {r.id: r.x for r in V.with_defaults(df, [("x", 9)], keys=["id"]).collect()}
    falsy = {r.id: r.x for r in V.with_defaults(df, [("x", 9)], keys=["id"], js_falsy=True).collect()}
    assert null_only == {1: 0, 2: 9, 3: 5} and falsy == {1: 9, 2: 9, 3: 5}


def test_scd2_history_and_merge(spark):
    snap = spark.createDataFrame([(1, dt.date(1995, 1, 1), 2, "employed", "ach"),
                                  (1, dt.date(1996, 1, 1), 2, "employed", "ach"),
                                  (1, dt.date(1997, 1, 1), 3, "employed", "ach")],
                                 "tenant_id long, snapshot_date date, household_size int, employment_status string, "
                                 "primary_payment_method string")
    v = sorted(WH.scd2_from_history(snap).collect(), key=lambda r: r.effective_date)
    assert [(r.effective_date, r.end_date, r.is_current) for r in v] == [
        (dt.date(1995, 1, 1), dt.date(1997, 1, 1), False), (dt.date(1997, 1, 1), None, True)]
    cur = WH.scd2_from_history(snap)
    inc = spark.createDataFrame([(1, 4, "employed", "ach"), (2, 1, "retired", "ach")],
                                "tenant_id long, household_size int, employment_status string, "
                                "primary_payment_method string")
    merged = WH.scd2_merge(cur, inc, "tenant_id", WH.SCD_TRACKED, AS_OF).collect()
    current = {(r.tenant_id, r.household_size) for r in merged if r.is_current}
    assert current == {(1, 4), (2, 1)}
    assert sum(1 for r in merged if r.tenant_id == 1) == 3


def _brute_first_response(actions, responses, hours):
    out = {}
    for aid, key, t in actions:
        cand = [r for k, r in responses if k == key and t <= r <= t + dt.timedelta(hours=hours)]
        out[aid] = min(cand) if cand else None
    return out


def test_first_response_matches_brute_force_with_hot_key(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    # key 0 is hot: about a third of all rows
    def key():
        return 0 if rnd.random() < 0.34 else rnd.randint(1, 20)
    actions = [(i, key(), base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 10))) for i in range(300)]
    responses = [(key(), base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 12))) for _ in range(600)]
    a = spark.createDataFrame(actions, "action_id long, tenant_id long, ts timestamp")
    r = spark.createDataFrame(responses, "tenant_id long, ts timestamp")
    got = {row.action_id: row.response_ts for row in RT.first_response_within(a, r, 48).collect()}
    assert got == _brute_first_response(actions, responses, 48)


def test_top_k_per_group_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.4 else rnd.randint(1, 5), rnd.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, id long")
    got = {}
    for r in SM.top_k_per_group(df, "k", [F.col("v").desc(), F.col("id")], 3).collect():
        got.setdefault(r.k, []).append((r.rank, r.v, r.id))
    for k in got:
        exp = sorted([(v, i) for kk, v, i in rows if kk == k], key=lambda t: (-t[0], t[1]))[:3]
        assert [(v, i) for _, v, i in sorted(got[k])] == exp


def test_ordered_neighbors_equals_plain_window_with_hot_key(spark):
    from pyspark.sql import Window
    from leaserisk.operators.windows import ordered_neighbors
    rnd = random.Random(11)
    base = dt.date(1995, 1, 1)
    rows = [(0 if rnd.random() < 0.34 else rnd.randint(1, 30), i, base + dt.timedelta(days=rnd.randint(0, 900)),
             rnd.randint(1, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "k long, id long, d date, v int")
    w = Window.partitionBy("k").orderBy("d", "id")
    plain = {r.id: (r.pv, r.nd, r.s, r.c) for r in df.select(
        "id", F.lag("v").over(w).alias("pv"), F.lead("d").over(w).alias("nd"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("s"),
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c")).collect()}
    got = ordered_neighbors(df, "k", F.trunc("d", "month"), ["d", "id"], prev_cols=["v"], next_cols=["d"],
                            prior_sums={"s": F.col("v")}, prior_count="c")
    mine = {r.id: (r.prev_v, r.next_d, r.s, r.c) for r in got.collect()}
    assert mine == plain


def test_asof_lookup_matches_brute_force_with_hot_key(spark):
    from leaserisk.operators.windows import asof_lookup
    rnd = random.Random(5)
    base = dt.date(1995, 1, 1)
    key = lambda: 0 if rnd.random() < 0.34 else rnd.randint(1, 15)
    versions = {}
    for _ in range(300):
        versions[(key(), base + dt.timedelta(days=rnd.randint(0, 1200)))] = rnd.randint(1, 99)
    facts = [(i, key(), base + dt.timedelta(days=rnd.randint(0, 1300))) for i in range(700)]
    f = spark.createDataFrame(facts, "id long, k long, d date")
    v = spark.createDataFrame([(k, d, x) for (k, d), x in versions.items()], "k long, vd date, x int")
    got = {r.id: r.x for r in asof_lookup(f, v, "k", "d", "vd", ["x"], lambda c: F.trunc(c, "month")).collect()}
    exp = {}
    for i, k, d in facts:
        cands = [(vd, x) for (kk, vd), x in versions.items() if kk == k and vd <= d]
        exp[i] = max(cands)[1] if cands else None
    assert got == exp


def test_market_as_of_per_row(spark):
    cols = {c: F.lit(None).cast("double") for c in FE.MARKET_COLS if c not in ("zip_code", "data_date",
                                                                                  "market_rent_median")}
    m = spark.createDataFrame([("1", dt.date(1998, 1, 1), 10.0), ("1", dt.date(1998, 6, 1), 20.0),
                               ("2", dt.date(1999, 1, 1), 30.0)],
                              "zip_code string, data_date date, market_rent_median double").withColumns(cols)
    rows = spark.createDataFrame([(1, "1", dt.date(1998, 3, 1)), (2, "1", dt.date(1998, 7, 1)),
                                  (3, "2", dt.date(1998, 12, 31)), (4, "1", dt.date(1997, 1, 1))],
                                 "lease_id long, zip_code string, d date")
    got = {r.lease_id: r.market_rent_median for r in FE.market_as_of_rows(rows, m, "lease_id", "d").collect()}
    assert got == {1: 10.0, 2: 20.0, 3: None, 4: None}


def test_split_target_requires_label(spark):
    import pytest
    df = spark.createDataFrame([(1, 2, 3, 0.5, 1)], "tenant_id long, lease_id long, property_id long, x double, y int")
    X, y = P.split_target(df, "y")
    assert X.columns == ["x"] and y.columns == ["y"]
    with pytest.raises(ValueError):
        P.split_target(df, "missing")


def test_histogram_median_equals_exact_median(spark):
    import numpy as np
    from leaserisk.functions import measures as M
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 100)) for _ in range(501)]
    df = spark.createDataFrame(rows, "g string, risk_score int")
    got = {r.g: r.median_risk_score for r in M.median_small_domain(df, "risk_score", ["g"], "median_risk_score")
           .collect()}
    for g in ("a", "b", None):
        assert got[g] == float(np.median([v for k, v in rows if k == g]))
    glob = M.median_small_domain(df, "risk_score").first()["median"]
    assert glob == float(np.median([v for _, v in rows]))


def test_top_k_of_a_hot_key_matches_brute_force_and_is_trimmed_before_the_shuffle(spark):
    rnd = random.Random(4)
    rows = [(0 if rnd.random() < 0.4 else rnd.randint(1, 5), rnd.randint(0, 50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, v long, id long")
    got = {}
    top = SM.top_k_per_group(df, "k", [F.col("v").desc(), F.col("id")], 4)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    for r in top.collect():
        got.setdefault(r.k, []).append((r.rank, r.v, r.id))
    for k in got:
        exp = sorted([(v, i) for kk, v, i in rows if kk == k], key=lambda t: (-t[0], t[1]))[:4]
        assert [(v, i) for _, v, i in sorted(got[k])] == exp


def test_medians_are_exact_on_ties_even_counts_and_far_values(spark):
    import statistics

    from leaserisk.operators import prep as PP

    rnd = random.Random(12)
    cols = {
        "spread": [rnd.uniform(-1e9, 1e9) for _ in range(6000)], "even": [float(i) for i in range(6000)],
        "ties": [float(rnd.choice([1, 2, 2, 2, 3])) for _ in range(6000)], "two": [0.0] * 3000 + [1.0] * 3000,
        "far": [rnd.choice([-1.0, 1.0]) * 10.0 ** rnd.randint(-300, 300) for _ in range(6000)],
        "holes": [None if rnd.random() < 0.5 else rnd.gauss(0, 1) for _ in range(6000)], "none": [None] * 6000}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols))
    got = PP.medians(df, list(cols)).first()
    for c, values in cols.items():
        own = [v for v in values if v is not None]
        assert got[f"median_{c}"] == (statistics.median(own) if own else None), c


def test_vocabulary_is_ranked_range_by_range(spark):
    from leaserisk.operators import prep as PP

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abAé \u4e2d") for _ in range(rnd.randint(0, 5))) for _ in range(3000)] + [None]
    rows = [(w, rnd.choice(words), "only") for w in words]
    df = spark.createDataFrame(rows, "c string, d string, e string")
    got = {(r.c, r.v): r.i for r in PP.vocabulary(df, ["c", "d", "e"], ranges=16).collect()}
    want = {}
    for k, c in enumerate("cde"):
        own = sorted({r[k] for r in rows} - {None}, key=lambda w: w.encode())
        want |= {(c, w): i for i, w in enumerate(own)}
    assert got == want
    assert PP.vocabulary(df.limit(0), ["c"]).collect() == []
