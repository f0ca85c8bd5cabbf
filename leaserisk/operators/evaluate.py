"""Evaluation as aggregations.

Confusion counts are four ``count_if`` in one pass.  The exact AUC and ROC
count rows by score first; the only ordered step runs over distinct scores:
at most 101 whole ones in one window, any others range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaserisk.functions.stats import with_stats
from leaserisk.session import checkpoint_dir

#: Risk scores are whole numbers from 0 to this.
TOP_SCORE = 100


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, label: str = "churned", pred: str = "predicted_churn") -> DataFrame:
    """TN/FP/FN/TP and accuracy, precision, recall, F1, specificity (0 on zero division)."""
    y = F.col(label) == 1
    p = F.col(pred)
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
               F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    prec = _div(tp, tp + fp)
    rec = _div(tp, tp + fn)
    return c.select("tp", "fp", "tn", "fn",
                    F.round(_div(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"),
                    F.round(prec, 6).alias("precision"),
                    F.round(rec, 6).alias("recall"),
                    F.round(_div(2 * prec * rec, prec + rec), 6).alias("f1"),
                    F.round(_div(tn, tn + fp), 6).alias("specificity"))


def score_counts(df: DataFrame, score: str = "risk_score", label: str = "churned") -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def with_below(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """``score_counts`` with the positives and negatives strictly below each score (``pos_below``, ``neg_below``).

    Without ``ranges`` one window runs over the scores, which must then be whole numbers from 0 to ``TOP_SCORE``
    (anything else raises), so it sees at most 102 rows.  With ``ranges`` the scores may be any numbers, as many as there
    are rows: they are dealt to that many ranges, written once, summed by range and inside their range.
    A null score is below all others.
    """
    def upto(order):
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        return {f"{c}_below": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("pos", "neg")}

    s = F.col("score")
    if ranges is None:
        whole = s.isNull() | (s.between(0, TOP_SCORE) & (s == F.floor(s)))
        checked = F.when(whole, s).otherwise(F.raise_error(F.lit(f"scores must be whole and 0 to {TOP_SCORE}, or give ranges")))
        return counts.withColumn("score", checked).withColumns(upto(Window.orderBy("score")))
    checkpoint_dir(counts.sparkSession)
    dealt = counts.repartitionByRange(ranges, "score").withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = dealt.groupBy("_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))  # at most ``ranges`` rows
    lower = sums.withColumns(upto(Window.orderBy("_range"))).select(
        "_range", F.col("pos_below").alias("_pos"), F.col("neg_below").alias("_neg"))
    inside = dealt.withColumns(upto(Window.partitionBy("_range").orderBy("score")))
    return inside.join(lower, "_range").select("score", "pos", "neg", (F.col("pos_below") + F.col("_pos")).alias("pos_below"),
                                               (F.col("neg_below") + F.col("_neg")).alias("neg_below"))


def roc_points(df: DataFrame, score: str = "risk_score", label: str = "churned", ranges: int | None = None) -> DataFrame:
    """Per threshold (score >= t) the true- and false-positive rates; ``ranges`` as in ``with_below``."""
    sc = with_below(score_counts(df, score, label), ranges)
    all_of = with_stats(sc, sc.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N")))
    return all_of.select(F.col("score").alias("threshold"), "pos", "neg",
                         F.round(_div(F.col("_P") - F.col("pos_below"), F.col("_P")), 6).alias("tpr"),
                         F.round(_div(F.col("_N") - F.col("neg_below"), F.col("_N")), 6).alias("fpr"))


def auc(df: DataFrame, score: str = "risk_score", label: str = "churned", ranges: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties counted one half (Mann-Whitney form); ``ranges`` as in ``with_below``.  Pairs are counted
    as doubles: their number outgrows a long from some 10**9 rows on."""
    sc = with_below(score_counts(df, score, label), ranges)
    pos = F.col("pos").cast("double")
    return sc.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                  F.sum(pos * F.col("neg_below") + 0.5 * pos * F.col("neg")).alias("_u")
                  ).select("positives", "negatives",
                           F.round(_div(F.col("_u"), F.col("positives").cast("double") * F.col("negatives")), 6).alias("auc"))


def accuracy_drift(df: DataFrame, date_col: str = "outcome_date", label: str = "churned",
                   pred: str = "predicted_churn") -> DataFrame:
    """Accuracy of stored predictions per outcome month."""
    ok = (F.col(label) == 1) == F.col(pred)
    return (df.groupBy(F.trunc(date_col, "month").alias("month"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("accuracy")))


def grouped_auc(df: DataFrame, group: str, score: str, label: str = "label") -> DataFrame:
    """(group, positives, negatives, auc): rank statistic of each group from counts by score, null where a group has one class."""
    counts = df.groupBy(group, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    below = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    s = counts.withColumn("_below", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    n = F.col("_pos").cast("double")
    u = F.sum(n * F.col("_below") + 0.5 * n * F.col("_neg"))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    return s.groupBy(group).agg(pos.alias("positives"), neg.alias("negatives"),
                                F.when((pos > 0) & (neg > 0), u / (pos.cast("double") * neg)).alias("auc"))


def monthly_metrics(df: DataFrame, date_col: str = "outcome_date", score: str = "risk_score", label: str = "churned",
                    pred: str = "predicted_churn") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and AUC of stored predictions per outcome month (AUC null in
    a month with one class)."""
    m = df.withColumn("month", F.trunc(date_col, "month"))
    y, p = F.col(label) == 1, F.col(pred)
    c = m.groupBy("month").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                               F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    auc_of = grouped_auc(m, "month", score, label).select(F.col("month").alias("_m"), F.round("auc", 6).alias("auc"))
    return c.join(auc_of, F.col("month").eqNullSafe(F.col("_m")), "left").select(
        "month", "tp", "fp", "tn", "fn", F.round(_div(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"),
        F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
        F.round(_div(2 * prec * rec, prec + rec), 6).alias("f1"), "auc")


def psi(expected: DataFrame, actual: DataFrame, bucket: Column) -> DataFrame:
    """M23 (our rule): population stability index of a bucket column between
    two score sets; empty buckets get a 1e-4 share."""
    e = expected.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("ne"))
    a = actual.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("na"))
    j = e.join(a, "b", "full").fillna(0, ["ne", "na"])
    j = with_stats(j, j.agg(F.sum("ne").alias("te"), F.sum("na").alias("ta")))
    pe = F.greatest(F.col("ne") / F.col("te"), F.lit(1e-4))
    pa = F.greatest(F.col("na") / F.col("ta"), F.lit(1e-4))
    return j.agg(F.round(F.sum((pa - pe) * F.log(pa / pe)), 6).alias("psi"))


def ab_variant(key: Column, split_pct: int = 50, multiplier: int = 7919) -> Column:
    """Deterministic traffic split by key."""
    return F.when(F.pmod(key * multiplier, F.lit(100)) < split_pct, "A").otherwise("B")


def ab_metrics(df: DataFrame, key: str = "lease_id", label: str = "churned",
               pred: str = "predicted_churn") -> DataFrame:
    ok = (F.col(label) == 1) == F.col(pred)
    return (df.withColumn("variant", ab_variant(F.col(key)))
            .groupBy("variant")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk_score"), 4).alias("avg_risk_score"),
                 F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("accuracy")))


def calibration(df: DataFrame, bucket: Column, prob: str = "churn_probability", label: str = "churned") -> DataFrame:
    """Per score bucket, mean predicted probability vs observed churn rate."""
    return (df.groupBy(bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg(prob), 6).alias("mean_predicted"),
                 F.round(F.avg(F.col(label).cast("double")), 6).alias("observed_rate")))
