"""Workflow fold, renewal history, campaigns and derived metrics on small hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leaserisk.functions import measures as M
from leaserisk.operators import evaluate as EV
from leaserisk.operators import retention as RT

DAY = dt.datetime(1999, 1, 1)


def test_workflow_branches_out_of_order_and_repeated_events(spark):
    starts = [(i, "HIGH") for i in range(1, 8)] + [(10, "MEDIUM"), (11, "MEDIUM"), (12, "MEDIUM")]
    straight = lambda lease, steps, outcome=None, shift=0: [
        (lease, DAY + dt.timedelta(hours=shift + n), 100 * lease + n, s, outcome if s in (3, 5) else None) for n, s in enumerate(steps)]
    log = (straight(1, [1, 2, 3, 4, 5, 7], "POSITIVE_RESPONSE") + straight(2, [1, 2, 3, 4, 5, 8], "NEGATIVE_RESPONSE")
           + straight(3, [1, 2, 3, 4, 5], "NO_RESPONSE") + straight(4, [1, 1, 3, 2, 2, 4, 3, 5, 4])  # waits for step 5
           + straight(5, [2, 3, 4, 5, 8, 6])  # step 1 never ends
           + straight(6, [1, 2, 3, 4, 5, 6, 6, 1, 2], "SOMETHING")  # an unknown outcome goes to the next step; then it is over
           + straight(10, [1, 2, 3, 5], "HIGH_ENGAGEMENT") + straight(11, [1, 2, 3, 5, 4], "LOW_ENGAGEMENT"))
    log += [log[0], log[0]]
    got = {r.lease_id: (r.current_step, r.completed_steps, r.branch, r.status) for r in RT.fold_workflow(
        spark.createDataFrame(starts, "lease_id long, risk_level string"),
        spark.createDataFrame(log[::-1], "lease_id long, ts timestamp, event_id long, step_id int, outcome string")).collect()}
    assert got == {
        1: (None, 6, "POSITIVE_RESPONSE", "COMPLETED"), 2: (None, 6, "NEGATIVE_RESPONSE", "COMPLETED"),
        3: (6, 5, "NO_RESPONSE", "IN_PROGRESS"), 4: (5, 4, None, "IN_PROGRESS"), 5: (1, 0, None, "PENDING"),
        6: (None, 6, "SOMETHING", "COMPLETED"), 7: (1, 0, None, "PENDING"),
        10: (None, 4, "HIGH_ENGAGEMENT", "COMPLETED"), 11: (None, 4, "LOW_ENGAGEMENT", "COMPLETED"), 12: (1, 0, None, "PENDING")}


def test_renewals_fold_into_an_existing_history(spark):
    leases = spark.createDataFrame([(1, dt.date(1999, 1, 1), 1000.0, 2, [(dt.date(1998, 1, 1), 900.0, 1000.0, 11.1111)]),
                                    (2, dt.date(1999, 1, 1), 500.0, 0, None), (3, dt.date(1999, 1, 1), 500.0, 0, [])],
                                   f"lease_id long, end_date date, monthly_rent double, renewal_count int, rent_increase_history {RT.RENT_HISTORY}")
    rows = [(1, dt.date(2000, 1, 1), 121000, 12), (1, dt.date(1999, 1, 1), 110000, 12), (1, dt.date(1998, 1, 1), 100000, 12), (2, dt.date(1999, 1, 1), 55000, 24)]
    renewals = spark.createDataFrame(rows + rows[:2], "lease_id long, effective_date date, new_rent_cents long, term_months int")
    got = {r.lease_id: r for r in RT.record_renewals(leases, renewals).collect()}
    assert sorted(got) == [1, 2] and got[1].renewal_count == 4 and got[1].new_monthly_rent == 1210.0
    assert got[1].new_end_date == dt.date(2000, 1, 1) + dt.timedelta(days=360)
    assert [(h.previousRent, h.newRent, h.increasePercent) for h in got[1].rent_increase_history] == [
        (900.0, 1000.0, 11.1111), (1000.0, 1100.0, 10.0), (1100.0, 1210.0, 10.0)]
    assert len(got[2].rent_increase_history) == 1
    state = RT.apply_renewals(leases, RT.record_renewals(leases, renewals))
    again = {r.lease_id: r for r in RT.record_renewals(state, renewals).collect()}  # a replay adds nothing
    assert [r.rent_increase_history for r in (again[1], again[2])] == [got[1].rent_increase_history, got[2].rent_increase_history]
    assert again[1].renewal_count == 4 and again[1].new_monthly_rent == 1210.0 and again[1].new_end_date == got[1].new_end_date


def test_campaign_made_twice_adds_new_leases_only(spark):
    cohort = spark.range(200).select(F.col("id").alias("lease_id"), F.col("id").alias("tenant_id"), F.lit("n").alias("neighborhood"),
                                     F.when(F.col("id") % 2 == 0, "HIGH").otherwise("MEDIUM").alias("risk_level"))
    log = RT.create_campaign(None, cohort.filter("lease_id < 150"), "c", 3)
    twice = RT.create_campaign(log, cohort.withColumn("risk_level", F.lit("HIGH")), "c", 3)
    rows = {r.lease_id: r for r in twice.collect()}
    assert twice.count() == len(rows) == 200 and rows[1].risk_level == "MEDIUM" and rows[151].risk_level == "HIGH"
    held = [r for r in rows.values() if r.arm == "control"]
    assert 20 <= len(held) <= 60 and all(r.action_type is None and r.status == "held-out" for r in held)
    assert RT.create_campaign(twice, cohort, "d", 3).count() == 400
    leases = spark.range(200).select(F.col("id").alias("lease_id"), F.when(F.col("id") % 4 < 2, "renewed").otherwise("expired").alias("renewal_status"))
    out = {r.risk_level: r for r in RT.campaign_outcomes(twice, leases).collect()}
    assert sum(r.treated + r.control for r in out.values()) == 200
    h = out["HIGH"]
    assert h.uplift == pytest.approx(h.treated_renewed / h.treated - h.control_renewed / h.control, abs=1e-6)


def test_metrics_of_several_grains_by_name(spark):
    p = spark.createDataFrame([("a", "HIGH", 90, True), ("a", "LOW", 10, False), (None, "HIGH", 80, True)],
                              "n string, risk_level string, risk_score int, predicted_churn boolean")
    acts = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3)], "n string, lease_id int")
    leases = spark.createDataFrame([("a", 1, "renewed"), ("a", 2, "expired"), ("b", 3, "expired")], "n string, lease_id int, renewal_status string")
    frames = {"prediction": p, "action": acts, "campaign_lease": leases}
    names = ["high_risk_tenant_count", "average_risk_score", "churn_ratio", "retention_campaign_roi"]
    one = M.metric_frame(names, frames).first()
    assert (one.high_risk_tenant_count, one.average_risk_score) == (2, 60.0)
    assert one.retention_campaign_roi == pytest.approx((4 / 3 * 4000 - 800) / 800 * 100, abs=1e-4)
    by = {r.n: r for r in M.metric_frame(names, frames, ["n"]).collect()}
    assert set(by) == {"a", "b", None} and by["b"].retention_campaign_roi == -100.0 and by["b"].high_risk_tenant_count is None
    assert by["a"].retention_campaign_roi == pytest.approx((1.5 * 4000 - 600) / 600 * 100, abs=1e-4) and by[None].retention_campaign_roi is None
    assert M.metric_frame(["churn_ratio"], {"prediction": p}).columns == ["churn_ratio"]
    with pytest.raises(KeyError):
        M.metric_frame(["no_such"], frames, ["n"])


def test_month_with_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(dt.date(1999, 1, d), s, y, s >= 50) for d, s, y in ((1, 90, 1), (2, 10, 0), (3, 50, 0))]
                               + [(dt.date(1999, 2, 1), 90, 1, True), (None, 90, 1, True)],
                               "outcome_date date, risk_score int, churned int, predicted_churn boolean")
    got = {str(r.month): r for r in EV.monthly_metrics(df).collect()}
    assert got["1999-01-01"].auc == 1.0 and (got["1999-01-01"].tp, got["1999-01-01"].fp) == (1, 1)
    assert got["1999-02-01"].auc is None and got["1999-02-01"].recall == 1.0 and got["None"].tp == 1
