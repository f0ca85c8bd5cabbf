"""Retention rules as tables.

Nothing is sent: the rules produce action rows, workflow plan rows, an
outbox work list and metrics.  Per-lease loops of the reference become
joins and projections over all leases at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaserisk import config as C
from leaserisk.functions.stats import with_stats
from leaserisk.sources.merge import newest

# ---------------------------------------------------------------------------
# Texts, templates and workflow steps of the retention rules.
# ---------------------------------------------------------------------------
HIGH_ACTION = ("property-manager-visit", "High risk - immediate intervention required")
MEDIUM_ACTION_TYPE = "email-campaign"
MEDIUM_NOTE_PREFIX = "Sent renewal incentive: "
LOW_TEMPLATE = "retention-standard"
TEMPLATES = {"HIGH": "retention-high-risk", "MEDIUM": "retention-medium-risk", "LOW": "retention-standard"}
SUBJECT_HIGH = "We'd Love to Keep You as a Resident!"
SUBJECT_OTHER = "Time to Renew Your Lease - Special Offers Inside"
SUBJECT_INCENTIVE = "🎁 Exclusive Renewal Offer Just For You!"
MANAGER_TEMPLATE = "property-manager-alert"
SUBJECT_MANAGER = "⚠️ HIGH RISK: Tenant "
SMS_TEXT = ("Hi ", ", we'd love to discuss your upcoming lease renewal. Our team will call you within 24 hours. "
            "Reply STOP to opt out.")
LOW_ACTION = ("renewal-notice", "Standard renewal notice")  # ours
ACTIONS_TAKEN = {
    "HIGH": ["manager-alert", "concierge-call", "email", "aip-workflow"],
    "MEDIUM": ["email-campaign", "incentive-offer"],
    "LOW": ["email"],
}
INCENTIVE_TEXT = {
    "rent-discount": "5% rent discount for first 3 months of renewal",
    "upgrade": "$500 credit for property upgrades or repairs",
    "gift-card": "$250 gift card upon lease renewal",
}
# (level, step_id, action, next_step, conditional_next, terminal)
WORKFLOW_STEPS = [
    ("HIGH", 1, "ALERT_PROPERTY_MANAGER", 2, None, False),
    ("HIGH", 2, "SCHEDULE_CONCIERGE_CALL", 3, None, False),
    ("HIGH", 3, "GENERATE_RETENTION_OFFER", 4, None, False),
    ("HIGH", 4, "SEND_RETENTION_EMAIL", 5, None, False),
    ("HIGH", 5, "MONITOR_RESPONSE", 6, "NO_RESPONSE:6,POSITIVE_RESPONSE:7,NEGATIVE_RESPONSE:8", False),
    ("HIGH", 6, "ESCALATE_TO_REGIONAL_MANAGER", None, None, True),
    ("HIGH", 7, "PROCESS_RENEWAL", None, None, True),
    ("HIGH", 8, "SCHEDULE_IN_PERSON_MEETING", None, None, True),
    ("MEDIUM", 1, "SEND_RETENTION_EMAIL", 2, None, False),
    ("MEDIUM", 2, "GENERATE_INCENTIVE_OFFER", 3, None, False),
    ("MEDIUM", 3, "MONITOR_ENGAGEMENT", 4, "HIGH_ENGAGEMENT:5,LOW_ENGAGEMENT:4", False),
    ("MEDIUM", 4, "SEND_REMINDER_EMAIL", None, None, True),
    ("MEDIUM", 5, "FLAG_FOR_FOLLOW_UP", None, None, True),
]
# (level, step_id) -> the step's constant parameters
STEP_PARAMETERS = {
    ("HIGH", 1): {"urgency": "HIGH", "slaHours": "24"},
    ("HIGH", 2): {"preferredTimeWindow": "business_hours", "callScript": "high_risk_retention", "maxAttempts": "3"},
    ("HIGH", 3): {"offerType": "personalized", "aiGenerated": "true"},
    ("HIGH", 4): {"emailTemplate": "high_risk_personalized", "includeOffer": "true", "trackResponse": "true"},
    ("HIGH", 5): {"monitoringWindowHours": "48", "responseChannels": "email,phone,portal", "escalateIfNoResponse": "true"},
    ("HIGH", 6): {"reason": "no_response_high_risk", "escalationLevel": "2"},
    ("HIGH", 7): {"initiateRenewalProcess": "true", "applyApprovedOffer": "true"},
    ("HIGH", 8): {"meetingType": "property_manager_visit", "urgency": "HIGH"},
    ("MEDIUM", 1): {"emailTemplate": "medium_risk_campaign", "aiPersonalization": "true"},
    ("MEDIUM", 2): {"offerTier": "standard", "expirationDays": "30"},
    ("MEDIUM", 3): {"monitoringWindowDays": "7", "engagementMetrics": "email_open,link_click,portal_login"},
    ("MEDIUM", 4): {"reminderType": "gentle", "emphasizeIncentive": "true"},
    ("MEDIUM", 5): {"followUpType": "phone_call", "scheduleDays": "14"},
}
WORKFLOW_PRIORITY = {"HIGH": "URGENT", "MEDIUM": "NORMAL"}
# Branch -> final step
BRANCH_STEP = {"NO_RESPONSE": 6, "POSITIVE_RESPONSE": 7, "NEGATIVE_RESPONSE": 8,
               "HIGH_ENGAGEMENT": 5, "LOW_ENGAGEMENT": 4}


def _ts(as_of) -> Column:
    return F.lit(str(as_of)).cast("date").cast("timestamp")


# -- R6 ---------------------------------------------------------------------
def incentive_offer(df: DataFrame, as_of=C.AS_OF) -> DataFrame:
    """Incentive by risk score; value of a rent discount = 5% of rent."""
    s = F.col("risk_score")
    typ = (F.when(s >= C.INCENTIVE_DISCOUNT_SCORE, "rent-discount")
           .when(s >= C.INCENTIVE_UPGRADE_SCORE, "upgrade").otherwise("gift-card"))
    value = (F.when(s >= C.INCENTIVE_DISCOUNT_SCORE, F.col("rent_cents") * 5 / 10000.0)
             .when(s >= C.INCENTIVE_UPGRADE_SCORE, F.lit(float(C.INCENTIVE_UPGRADE_VALUE)))
             .otherwise(F.lit(float(C.INCENTIVE_GIFT_VALUE))))
    desc = F.create_map(*[x for k, v in INCENTIVE_TEXT.items() for x in (F.lit(k), F.lit(v))])
    return (df.withColumn("incentive_type", typ)
            .withColumns({"incentive_value": value,
                          "incentive_description": desc[F.col("incentive_type")],
                          "expires_at": F.date_add(F.lit(str(as_of)).cast("date"), C.INCENTIVE_EXPIRY_DAYS),
                          "risk_score_at_offer": s}))


# -- R5 / R3 / R7 ------------------------------------------------------------------
def auto_trigger(leases_pred: DataFrame, as_of=C.AS_OF) -> DataFrame:
    """R5 (+R7): one action row per active HIGH / MEDIUM lease (LOW in the
    renewal window gets the standard notice).  Rows carry ``error`` when the
    lease cannot be processed (no property / tenant to contact)."""
    a = leases_pred.filter((F.col("status") == "active") & F.col("risk_level").isNotNull())
    a = incentive_offer(a, as_of)
    lvl = F.col("risk_level")
    in_window = (F.col("end_date") > F.lit(str(as_of)).cast("date")) & \
        (F.col("end_date") <= F.date_add(F.lit(str(as_of)).cast("date"), C.RENEWAL_WINDOW_DAYS))
    a = a.filter((lvl != "LOW") | in_window)
    taken = lambda level: F.array(*[F.lit(x) for x in ACTIONS_TAKEN[level]])
    return a.select(
        "lease_id", "tenant_id", "property_id", "risk_level", "risk_score",
        F.when(lvl == "HIGH", HIGH_ACTION[0]).when(lvl == "MEDIUM", MEDIUM_ACTION_TYPE)
        .otherwise(LOW_ACTION[0]).alias("action_type"),
        F.when(lvl == "HIGH", HIGH_ACTION[1])
        .when(lvl == "MEDIUM", F.concat(F.lit(MEDIUM_NOTE_PREFIX), F.col("incentive_description")))
        .otherwise(F.lit(LOW_ACTION[1])).alias("notes"),
        F.when(lvl == "HIGH", taken("HIGH")).when(lvl == "MEDIUM", taken("MEDIUM"))
        .otherwise(taken("LOW")).alias("actions_taken"),
        F.when(lvl == "MEDIUM", F.col("incentive_type")).alias("incentive_type"),
        F.when(lvl == "MEDIUM", F.col("incentive_value")).alias("incentive_value"),
        _ts(as_of).alias("triggered_at"),
        F.lit("pending").alias("status"),
        F.when(F.col("property_id").isNull(), F.lit("lease has no property")).alias("error"))


def action_rows(actions: DataFrame) -> DataFrame:
    """One row for each action taken on a lease, in order; leases with an error have none."""
    return (actions.filter(F.col("error").isNull())
            .select("lease_id", "tenant_id", "risk_level", F.posexplode("actions_taken").alias("step", "action"),
                    "triggered_at", "status"))


def trigger_summary(actions: DataFrame) -> DataFrame:
    """R5 counts: processed per level, actions triggered, errors (one pass)."""
    ok = F.col("error").isNull()
    return actions.agg(
        F.count_if(ok & (F.col("risk_level") == "HIGH")).alias("high_risk_processed"),
        F.count_if(ok & (F.col("risk_level") == "MEDIUM")).alias("medium_risk_processed"),
        F.count_if(ok & (F.col("risk_level") == "LOW")).alias("low_risk_notices"),
        F.count_if(ok & (F.col("risk_level") != "LOW")).alias("actions_triggered"),
        F.count_if(~ok).alias("errors"))


def record_actions(log: DataFrame, new_actions: DataFrame) -> DataFrame:
    """Append action rows to an action log (schema aligned by name)."""
    cols = log.columns
    return log.unionByName(new_actions.select(*[F.col(c) if c in new_actions.columns
                                                else F.lit(None).cast(log.schema[c].dataType).alias(c)
                                                for c in cols]))


# -- R8 ---------------------------------------------------------------------
def workflow_steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(*step, STEP_PARAMETERS[step[:2]]) for step in WORKFLOW_STEPS],
        "risk_level string, step_id int, action string, next_step int, conditional_next string, "
        "terminal boolean, parameters map<string, string>")


def workflow_plan(leases_pred: DataFrame, spark: SparkSession) -> DataFrame:
    """One row per (lease, step) for active HIGH / MEDIUM leases; ``parameters``
    holds the step's constants, the lease's own values are columns.

    The steps table has 13 rows and is broadcast; the join is an equi-join
    on risk level (each lease meets 5 or 8 rows)."""
    steps = F.broadcast(workflow_steps(spark))
    a = leases_pred.filter((F.col("status") == "active") & F.col("risk_level").isin("HIGH", "MEDIUM"))
    prio = F.when(F.col("risk_level") == "HIGH", WORKFLOW_PRIORITY["HIGH"]).otherwise(WORKFLOW_PRIORITY["MEDIUM"])
    return (a.select("lease_id", "tenant_id", "risk_level", "risk_score").join(steps, "risk_level")
            .withColumns({"priority": prio,
                          "estimated_turnover_cost": F.lit(C.TURNOVER_COST),
                          "risk_mitigation_value": F.col("risk_score") * C.MITIGATION_PER_POINT}))


# -- T1 batch twin: first response within a window, skew safe -------------------
def first_response_within(actions: DataFrame, responses: DataFrame, hours: int = 48,
                          key: str = "tenant_id", ts: str = "ts", bucket_hours: int = 6) -> DataFrame:
    """For every action, the first response of the same key with
    action_ts <= response_ts <= action_ts + hours.

    No pairwise expansion: actions and responses are merged into one sorted
    stream per (key, time bucket); the next response inside the bucket comes
    from a forward window, and later buckets are looked up in a per-bucket
    first-response table (one row per key and bucket).  A hot key is spread
    over its buckets; an unanswered action probes at most hours / bucket_hours
    later buckets.
    """
    width = bucket_hours * 3600
    n_later = -(-hours // bucket_hours)
    bk = lambda c: F.floor(F.unix_seconds(c) / width).cast("long")
    act = actions.select(F.col("action_id"), F.col(key), F.col(ts).alias("_t"), F.lit(0).alias("_k"))
    rsp = responses.select(F.lit(None).cast("long").alias("action_id"), F.col(key), F.col(ts).alias("_t"),
                           F.lit(1).alias("_k"))
    u = act.unionByName(rsp).withColumn("_b", bk(F.col("_t")))
    w = (Window.partitionBy(key, "_b").orderBy("_t", "_k")
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    same = (u.withColumn("_next", F.min(F.when(F.col("_k") == 1, F.col("_t"))).over(w))
            .filter(F.col("_k") == 0).select("action_id", key, "_t", "_b", "_next"))
    first = responses.groupBy(F.col(key), bk(F.col(ts)).alias("_rb")).agg(F.min(ts).alias("_first"))
    later = (same.filter(F.col("_next").isNull())
             .select("action_id", key, "_b", F.explode(F.sequence(F.lit(1), F.lit(n_later))).alias("_o"))
             .withColumn("_rb", F.col("_b") + F.col("_o"))
             .join(first, [key, "_rb"])
             .groupBy("action_id").agg(F.min("_first").alias("_later")))
    limit = F.col("_t") + F.expr(f"INTERVAL {hours} HOURS")
    res = same.join(later, "action_id", "left").withColumn("_r", F.coalesce("_next", "_later"))
    return res.select("action_id", F.when(F.col("_r") <= limit, F.col("_r")).alias("response_ts"))


def engagement_counts(starts: DataFrame, engagement: DataFrame, days: int = 7,
                      key: str = "tenant_id") -> DataFrame:
    """T2 batch twin: engagement events in (start, start + days] per start row
    (one start per key, so the join is linear in the events)."""
    e = engagement.select(key, F.col("ts").alias("_e"))
    j = (starts.join(e, key, "left")
         .filter(F.col("_e").isNull() | ((F.col("_e") > F.col("started_at"))
                                         & (F.col("_e") <= F.col("started_at") + F.expr(f"INTERVAL {days} DAYS")))))
    return j.groupBy(key, "started_at").agg(F.count("_e").alias("engagement_count"))


# -- R9 / A27 -------------------------------------------------------------------------
def workflow_status(plan: DataFrame, actions: DataFrame, responses: DataFrame, engagement: DataFrame,
                    now: DataFrame, threshold: int = C.ENGAGEMENT_HIGH_THRESHOLD) -> DataFrame:
    """Workflow state per lease from the event log, as of ``now`` (one row, one timestamp).

    The workflow starts at the tenant's first retention action (a sent
    message).  HIGH: a response within 48 h -> POSITIVE_RESPONSE, otherwise
    NO_RESPONSE.  MEDIUM: engagement events within 7 days >= threshold ->
    HIGH_ENGAGEMENT, else LOW_ENGAGEMENT.  While the window is open and
    nothing has decided it, the workflow is IN_PROGRESS at its monitoring step.
    Leases whose tenant has no action yet stay at step 1.
    """
    wf = plan.select("lease_id", "tenant_id", "risk_level", "priority").dropDuplicates(["lease_id"])
    start = (actions.groupBy("tenant_id")
             .agg(F.min_by(F.struct(F.col("triggered_at").alias("started_at"), "action_id"),
                           F.struct("triggered_at", "action_id")).alias("s"))
             .select("tenant_id", "s.started_at", "s.action_id"))
    first_actions = start.select("action_id", "tenant_id", F.col("started_at").alias("ts"))
    resp = first_response_within(first_actions, responses.select("tenant_id", "ts"), 48)
    eng = engagement_counts(start.select("tenant_id", "started_at"), engagement, 7)
    j = (wf.join(start, "tenant_id", "left")
         .join(resp, "action_id", "left")
         .join(eng.drop("started_at"), "tenant_id", "left"))
    j = with_stats(j, now.toDF("_now"))
    closed = lambda window: F.col("started_at") + F.expr(f"INTERVAL {window}") < F.col("_now")
    branch = (F.when(F.col("started_at").isNull(), F.lit(None))
              .when(F.col("risk_level") == "HIGH",
                    F.when(F.col("response_ts").isNotNull(), "POSITIVE_RESPONSE").when(closed("48 HOURS"), "NO_RESPONSE"))
              .otherwise(F.when(F.coalesce("engagement_count", F.lit(0)) >= threshold, "HIGH_ENGAGEMENT")
                         .when(closed("7 DAYS"), "LOW_ENGAGEMENT")))
    step_map = F.create_map(*[x for k, v in BRANCH_STEP.items() for x in (F.lit(k), F.lit(v))])
    monitor = F.when(F.col("risk_level") == "HIGH", 5).otherwise(3)
    return (j.withColumn("branch", branch)
            .select("lease_id", "tenant_id", "risk_level", "priority", "started_at",
                    "response_ts", F.coalesce("engagement_count", F.lit(0)).alias("engagement_count"),
                    "branch",
                    F.when(F.col("started_at").isNull(), F.lit(1)).when(F.col("branch").isNull(), monitor)
                    .otherwise(step_map[F.col("branch")]).alias("current_step"),
                    F.when(F.col("started_at").isNull(), F.lit(0)).when(F.col("branch").isNull(), monitor - 1)
                    .otherwise(monitor + 1).alias("completed_steps"),
                    F.when(F.col("started_at").isNull(), "PENDING").when(F.col("branch").isNull(), "IN_PROGRESS")
                    .otherwise("COMPLETED").alias("status"),
                    F.when(F.col("response_ts").isNotNull(),
                           (F.unix_micros("response_ts") - F.unix_micros("started_at")) / 3.6e9)
                    .alias("hours_to_response")))


def fold_workflow(starts: DataFrame, log: DataFrame) -> DataFrame:
    """R9 from an event log: (lease_id, risk_level, current_step, completed_steps, branch, status, last_event_at).

    ``starts`` (lease_id, risk_level) begin at step 1; ``log`` (lease_id, ts, event_id, step_id, outcome) tells that a step has
    ended.  In order of (ts, event_id) an event moves its workflow only if it is of the current step and after the event
    that led there; others (out of order, repeated, after the end) change nothing.  A conditional step goes where its outcome
    says, without a known outcome to its next step, and its outcome becomes the branch.  Each round finds every workflow's next
    event by a partial minimum, as many rounds as the longest path has steps; no lease's events are gathered.
    """
    onward, choices, rounds = {}, {}, 0
    for level, step, _, nxt, conditional, _ in WORKFLOW_STEPS:
        onward[f"{level}:{step}"] = nxt
        for choice in (conditional or "").split(",") if conditional else ():
            outcome, to = choice.split(":")
            choices[f"{level}:{step}:{outcome}"] = int(to)
    for level in WORKFLOW_PRIORITY:
        at, n = 1, 0
        while at is not None:
            at, n = onward[f"{level}:{at}"], n + 1
        rounds = max(rounds, n)
    pairs = lambda d: F.create_map(*[x for k, v in d.items() if v is not None for x in (F.lit(k), F.lit(v))])
    forks = sorted({k.rsplit(":", 1)[0] for k in choices})
    none = starts.select("lease_id", F.explode(F.sequence(F.lit(1), F.lit(max(s for _, s, *_ in WORKFLOW_STEPS)))).alias("step_id"))
    # A row without an event for each lease and step, so that an inner join keeps workflows that wait.
    events = log.select("lease_id", "step_id", F.struct("ts", "event_id", "outcome").alias("e")).unionByName(none, allowMissingColumns=True)
    state = starts.select("lease_id", "risk_level").distinct().withColumns({
        "step_id": F.lit(1), "done": F.lit(0), "branch": F.lit(None).cast("string"),
        "last": F.lit(None).cast("struct<ts:timestamp,event_id:bigint>")})
    for _ in range(rounds):
        waiting = state.withColumn("_ended", F.col("step_id").isNull()).withColumn(
            "step_id", F.coalesce("step_id", F.lit(1)))  # ended ones meet the rows of step 1 and stay
        after = F.col("last").isNull() | (F.struct("e.ts", "e.event_id") > F.col("last"))
        ended = F.col("_ended")
        hit = F.min(F.when(F.col("e").isNotNull() & ~ended & after, F.col("e")))
        found = (events.join(waiting, ["lease_id", "step_id"])
                 .groupBy("lease_id", "risk_level", "step_id", "done", "branch", "last", "_ended").agg(hit.alias("h")))
        here = F.concat_ws(":", "risk_level", "step_id")
        chosen = pairs(choices)[F.concat_ws(":", here, F.coalesce("h.outcome", F.lit("")))]
        moved = F.col("h").isNotNull()
        state = found.select(
            "lease_id", "risk_level",
            F.when(ended, F.lit(None)).when(moved, F.coalesce(chosen, pairs(onward)[here])).otherwise(F.col("step_id")).alias("step_id"),
            (F.col("done") + moved.cast("int")).alias("done"),
            F.when(moved & here.isin(forks), F.col("h.outcome")).otherwise(F.col("branch")).alias("branch"),
            F.when(moved, F.struct("h.ts", "h.event_id")).otherwise(F.col("last")).alias("last"))
    return state.select(
        "lease_id", "risk_level", F.col("step_id").alias("current_step"), F.col("done").alias("completed_steps"), "branch",
        F.when(F.col("step_id").isNull(), "COMPLETED").when(F.col("done") == 0, "PENDING").otherwise("IN_PROGRESS").alias("status"),
        F.col("last.ts").alias("last_event_at"))


def workflow_metrics(status: DataFrame) -> DataFrame:
    """By priority and status: count, outcome counts, success rate, avg hours."""
    success = F.coalesce(F.col("branch").isin("POSITIVE_RESPONSE", "HIGH_ENGAGEMENT"), F.lit(False))
    return status.groupBy("priority", "status").agg(
        F.count(F.lit(1)).alias("workflows"),
        F.count_if(success).alias("successful"),
        F.count_if(F.col("branch").isin("NO_RESPONSE", "LOW_ENGAGEMENT")).alias("unsuccessful"),
        F.round(F.count_if(success) / F.count(F.lit(1)), 6).alias("success_rate"),
        F.round(F.avg("hours_to_response"), 4).alias("avg_hours_to_response"))


# -- A5 / A6 / R11 ------------------------------------------------------------------------
def action_leases(actions: DataFrame, leases: DataFrame) -> DataFrame:
    """Attach each action to its tenant's most recent lease (the per-tenant
    side is reduced to one row per tenant before the join; tenants without a
    lease have no lease to campaign on and drop out)."""
    cur = (leases.groupBy("tenant_id")
           .agg(F.max_by(F.struct("lease_id", "renewal_status"), F.struct("start_date", "lease_id")).alias("l"))
           .select("tenant_id", "l.lease_id", "l.renewal_status"))
    return actions.join(cur, "tenant_id")


def campaign_actions(actions: DataFrame, start, end, mode: str = "action") -> DataFrame:
    """Q13: ``action`` keeps actions inside [start, end]; ``document`` keeps all
    actions of leases with some action >= start and some action <= end."""
    s, e = F.lit(str(start)).cast("timestamp"), F.lit(str(end)).cast("timestamp")
    t = F.col("triggered_at")
    if mode == "action":
        return actions.filter((t >= s) & (t <= e))
    m = (actions.groupBy("lease_id")
         .agg(F.max(t).alias("_mx"), F.min(t).alias("_mn"))
         .filter((F.col("_mx") >= s) & (F.col("_mn") <= e)).select("lease_id"))
    return actions.join(m, "lease_id", "left_semi")


def campaign_metrics(camp: DataFrame, lease_risk: DataFrame) -> DataFrame:
    """A5 (one row): total actions, leases with campaigns, by risk level (lease
    grain), renewal rate % (lease grain)."""
    per_lease = (camp.groupBy("lease_id")
                 .agg(F.count(F.lit(1)).alias("n"), F.first("renewal_status").alias("renewal_status"))
                 .join(lease_risk.select("lease_id", "risk_level"), "lease_id", "left"))
    return per_lease.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_campaigns"),
        F.count(F.lit(1)).alias("leases_with_campaigns"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"),
        F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_risk"),
        F.count_if(F.col("risk_level") == "LOW").alias("low_risk"),
        F.count_if(F.col("renewal_status") == "renewed").alias("renewed_leases"),
    ).withColumn("renewal_rate", F.when(F.col("leases_with_campaigns") > 0,
                                        F.col("renewed_leases") / F.col("leases_with_campaigns") * 100)
                 .otherwise(F.lit(0.0)))


def campaign_by_type(camp: DataFrame) -> DataFrame:
    return camp.groupBy("action_type").agg(F.count(F.lit(1)).alias("actions"))


def roi(metrics: DataFrame, turnover_cost: int = C.TURNOVER_COST,
        campaign_cost: int = C.CAMPAIGN_COST) -> DataFrame:
    """Avoided, savings, costs, net, roi % (0 when cost is 0)."""
    avoided = F.col("total_campaigns") * (F.col("renewal_rate") / 100)
    cost = F.col("total_campaigns") * campaign_cost
    savings = avoided * turnover_cost
    net = savings - cost
    return metrics.select(
        "total_campaigns",
        F.round(avoided).cast("long").alias("turnovers_avoided"),
        F.round(savings, 4).alias("cost_savings"),
        cost.alias("campaign_costs"),
        F.round(net, 4).alias("net_savings"),
        F.round(F.when(cost > 0, net / cost * 100).otherwise(F.lit(0.0)), 4).alias("roi_percentage"),
        F.round("renewal_rate", 4).alias("renewal_rate"))


def cohort_outcomes(history: DataFrame, leases: DataFrame, run_date, levels=("HIGH", "MEDIUM")) -> DataFrame:
    """Campaign for the leases scored at ``run_date`` with the given
    levels; outcome = the lease's renewal status as of now."""
    c = (history.filter((F.col("prediction_date") == F.lit(str(run_date)).cast("date"))
                        & F.col("risk_level").isin(*levels))
         .select("lease_id", "risk_level", "neighborhood"))
    return (c.join(leases.select("lease_id", "renewal_status"), "lease_id")
            .groupBy("neighborhood", "risk_level", "renewal_status")
            .agg(F.count(F.lit(1)).alias("leases")))


def campaign_cohort(history: DataFrame, levels=("HIGH", "MEDIUM")) -> DataFrame:
    """Leases that some of the runs scored at one of the levels, by their newest such run."""
    row = F.struct("prediction_date", "tenant_id", "risk_level", "neighborhood")
    newest_run = history.filter(F.col("risk_level").isin(*levels)).groupBy("lease_id").agg(F.max(row).alias("r"))
    return newest_run.select("lease_id", "r.tenant_id", "r.risk_level", "r.neighborhood")


def create_campaign(log: DataFrame | None, cohort: DataFrame, campaign: str, seed: int, control_pct: int = 20) -> DataFrame:
    """The action log after creating a campaign for a cohort, one row per lease.

    A lease's arm follows from its id and ``seed``; control leases get a row without an action.  The key is the campaign and
    the lease, and rows that the log has stay as they are: creating again adds new leases only.
    """
    arm = F.when(F.pmod(F.col("lease_id") * 7919 + seed, F.lit(100)) < control_pct, "control").otherwise("treated")
    treated = F.col("arm") == "treated"
    new = cohort.dropDuplicates(["lease_id"]).withColumn("arm", arm).select(
        F.xxhash64(F.lit(campaign), "lease_id").alias("action_key"), F.lit(campaign).alias("campaign"), "lease_id", "tenant_id",
        "neighborhood", "risk_level", "arm",
        F.when(treated, F.when(F.col("risk_level") == "HIGH", HIGH_ACTION[0]).otherwise(MEDIUM_ACTION_TYPE)).alias("action_type"),
        F.when(treated, "pending").otherwise("held-out").alias("status"))
    if log is None:
        return new
    return log.unionByName(new.join(log.select("campaign", "lease_id"), ["campaign", "lease_id"], "left_anti").select(*log.columns))


def campaign_outcomes(log: DataFrame, leases: DataFrame) -> DataFrame:
    """By risk level, leases and renewals of both arms, and the treated renewal rate less that of the control."""
    j = log.join(leases.select("lease_id", "renewal_status"), "lease_id")
    n = lambda arm: F.count_if(F.col("arm") == arm)
    renewed = lambda arm: F.count_if((F.col("arm") == arm) & (F.col("renewal_status") == "renewed"))
    rate = lambda arm: F.col(f"{arm}_renewed") / F.nullif(F.col(arm), F.lit(0))
    return j.groupBy("risk_level").agg(n("treated").alias("treated"), n("control").alias("control"), renewed("treated").alias("treated_renewed"),
                                       renewed("control").alias("control_renewed")).withColumn(
        "uplift", F.round(rate("treated") - rate("control"), 6))


# -- R4 / R2 / R1 ----------------------------------------------------------------------
RENT_HISTORY = "array<struct<effectiveDate:date,previousRent:double,newRent:double,increasePercent:double>>"


def record_renewals(leases: DataFrame, renewals: DataFrame | None = None) -> DataFrame:
    """Renewals folded into their leases, in order of their dates: each appends an entry to the lease's
    rent history (F19), sets rent and end date and counts.

    ``renewals`` (lease_id, effective_date, new_rent_cents, term_months) may hold several rows of a lease, in any order and more
    than once; those at or before the history's last entry are recorded already and change nothing.  Leases may bring
    ``rent_increase_history``.  Default: one renewal of each renewed lease at its end, by its last increase.
    """
    from leaserisk.functions import scalars as X
    if renewals is None:
        pct = F.round(F.col("last_rent_increase_pct") * 100).cast("long")
        renewals = leases.filter(F.col("renewal_status") == "renewed").select(
            "lease_id", F.col("end_date").alias("effective_date"),
            F.floor((F.col("rent_cents") * (100 + pct) + 50) / 100).cast("long").alias("new_rent_cents"),
            F.col("lease_term_months").alias("term_months"))
    old = F.col("rent_increase_history") if "rent_increase_history" in leases.columns else F.lit(None)
    base = leases.withColumn("_old", F.coalesce(old.cast(RENT_HISTORY), F.array().cast(RENT_HISTORY)))
    steps = renewals.groupBy("lease_id").agg(F.array_sort(F.collect_set(F.struct(
        F.col("effective_date").cast("date").alias("d"), F.col("new_rent_cents").cast("long").alias("c"),
        F.col("term_months").cast("int").alias("t")))).alias("_steps"))
    j = base.join(steps, "lease_id")
    last = F.element_at("_old", -1)["effectiveDate"]
    fresh = F.filter("_steps", lambda s: F.col("_last").isNull() | (s["d"] > F.col("_last")))
    j = j.withColumn("_last", F.when(F.size("_old") > 0, last)).withColumn("_steps", fresh)
    rents = F.transform("_steps", lambda s: s["c"] / 100.0)
    before = F.concat(F.array("monthly_rent"), rents)
    entries = F.transform("_steps", lambda s, i: F.struct(
        s["d"].alias("effectiveDate"), F.get(before, i).alias("previousRent"), (s["c"] / 100.0).alias("newRent"),
        F.round(X.rent_increase_pct(s["c"] / 100.0, F.get(before, i)), 4).alias("increasePercent")).cast(RENT_HISTORY[6:-1]))
    n, newest_step = F.size("_steps"), F.get("_steps", F.size("_steps") - 1)
    return j.select(
        "lease_id",
        F.when(n > 0, F.date_add(newest_step["d"], newest_step["t"] * 30)).otherwise(F.col("end_date")).alias("new_end_date"),
        F.when(n > 0, newest_step["c"] / 100.0).otherwise(F.col("monthly_rent")).alias("new_monthly_rent"),
        (F.col("renewal_count") + n).alias("renewal_count"), F.lit("renewed").alias("status"),
        F.concat("_old", entries).alias("rent_increase_history"))


def apply_renewals(leases: DataFrame, recorded: DataFrame) -> DataFrame:
    """(lease_id, end_date, monthly_rent, renewal_count, rent_increase_history) of all ``leases`` after ``recorded`` renewals."""
    r = recorded.select("lease_id", "new_end_date", "new_monthly_rent", F.col("renewal_count").alias("_n"), "rent_increase_history")
    return leases.select("lease_id", "end_date", "monthly_rent", "renewal_count").join(r, "lease_id", "left").select(
        "lease_id", F.coalesce("new_end_date", "end_date").alias("end_date"), F.coalesce("new_monthly_rent", "monthly_rent").alias("monthly_rent"),
        F.coalesce("_n", "renewal_count").alias("renewal_count"), "rent_increase_history")


def upsert(snapshot: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """R2: keyed upsert = union + the greatest row per key by version, then by all columns (a total order)."""
    return newest(snapshot.unionByName(updates.select(*snapshot.columns)), key, version)


# -- R10 -----------------------------------------------------------------------------
def outbox(actions: DataFrame, tenants: DataFrame, properties: DataFrame, default_manager_email: str | None = None,
           sms_enabled: bool = False) -> DataFrame:
    """Message work list (no sending): retention e-mails, incentive offers,
    manager alerts for HIGH leases (to the default address, as properties name
    none) and, if enabled, the concierge's text message.  Rows without a
    recipient are dropped."""
    a = (actions.filter(F.col("error").isNull())
         .join(tenants.select("tenant_id", "email", "phone", "first_name", "full_name"), "tenant_id", "left")
         .join(properties.select("property_id", "address"), "property_id", "left"))
    lvl = F.col("risk_level")

    def rows(of, channel, recipient, template, subject, message=None):
        return of.select("lease_id", F.lit(channel).alias("channel"), recipient.alias("recipient"), template.alias("template"),
                         subject.alias("subject"), (F.lit(None).cast("string") if message is None else message).alias("message"))

    parts = [rows(a, "email", F.col("email"), F.when(lvl == "HIGH", TEMPLATES["HIGH"]).when(lvl == "MEDIUM", TEMPLATES["MEDIUM"])
                  .otherwise(TEMPLATES["LOW"]), F.when(lvl == "HIGH", SUBJECT_HIGH).otherwise(SUBJECT_OTHER)),
             rows(a.filter(lvl == "MEDIUM"), "email", F.col("email"), F.lit("incentive-offer"), F.lit(SUBJECT_INCENTIVE))]
    high = a.filter(lvl == "HIGH")
    if default_manager_email:
        parts.append(rows(high, "email", F.lit(default_manager_email), F.lit(MANAGER_TEMPLATE),
                          F.concat(F.lit(SUBJECT_MANAGER), F.col("full_name"), F.lit(" - "), F.col("address"))))
    if sms_enabled:
        parts.append(rows(high, "sms", F.col("phone"), F.lit("concierge-call"), F.lit(None).cast("string"),
                          F.concat(F.lit(SMS_TEXT[0]), F.col("first_name"), F.lit(SMS_TEXT[1]))))
    return reduce(DataFrame.unionByName, parts).filter(F.col("recipient").isNotNull())
