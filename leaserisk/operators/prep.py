"""Model input preparation with frozen statistics (M1-M5, Q8).

``fit_*`` runs one aggregation pass over the training frame and returns a
small plain-Python state (medians, modes, means, stds, vocabularies);
``apply_*`` turns that state into Column expressions, so scoring one row or a
billion rows gives the same values.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaserisk.functions.stats import with_stats
from leaserisk.session import checkpoint_dir

# Sketch accuracy (rank error 1 / 10,000) and the ranks that bracket a median.
BRACKET_ACCURACY, BRACKET = 10_000, (0.499, 0.501)
# Parts of a bracket: only those that hold a middle value are ranked.
BRACKET_CELLS = 1_024


def _numeric(df: DataFrame, cols):
    return [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]


def _long(df: DataFrame, cols) -> DataFrame:
    """(c, v): a row per value that is not null, ``c`` the column's place in ``cols``.  Statistics by ``c`` are one small
    aggregate; one with a few of them for each column is a method too large for the JVM to compile."""
    values = F.array(*[F.col(c).cast("double") for c in cols]) if cols else F.array().cast("array<double>")
    return df.select(F.posexplode(values).alias("c", "v")).filter(F.col("v").isNotNull())


# -- M2: impute ---------------------------------------------------------------
def medians(df: DataFrame, cols) -> DataFrame:
    """One row ``median_<c>``: the exact median, the mean of the two middle
    values for an even count, nulls left out.

    A small sketch brackets each column's median; rows below the bracket are only
    counted, and the values inside (about a 500th of the rows) are counted
    by value.  A sketch of those cuts the bracket into ``BRACKET_CELLS`` cells, whose
    counts tell which one or two hold the middle ranks; only their values are ranked, cell by
    cell (about one distinct value in 500,000).  Equal values lie in one cell, so ties and
    even counts are exact.  Brackets and cells are a few rows a column and are broadcast: dealt by
    column, the rows would go to as many tasks as there are columns.
    """
    long = _long(df, cols)
    cuts = long.groupBy("c").agg(F.percentile_approx("v", list(BRACKET), BRACKET_ACCURACY).alias("q"),
                                 F.count(F.lit(1)).alias("n"))
    cuts = cuts.select("c", F.array(F.col("n").cast("double"), F.col("q")[0], F.col("q")[1]).alias("q"))
    near = long.join(F.broadcast(cuts), "c").filter(F.col("v") <= F.col("q")[2])
    by_value = (near.groupBy("c", F.when(F.col("v") >= F.col("q")[1], F.col("v")).alias("v"))  # null: below the bracket
                .agg(F.count(F.lit(1)).alias("m"), F.first(F.col("q")[0]).cast("long").alias("n")))
    # All its uses read all its columns, so that they are one exchange.
    by_value = by_value.filter((F.col("m") > 0) & (F.col("n") > 0))
    steps = [i / BRACKET_CELLS for i in range(1, BRACKET_CELLS)]
    finer = by_value.groupBy("c").agg(F.array_distinct(F.percentile_approx("v", steps, BRACKET_ACCURACY)).alias("at"))
    inside = by_value.join(F.broadcast(finer), "c").select("c", "v", "m", "n", F.when(F.col("v").isNull(), F.lit(-1)).otherwise(
        F.size(F.filter("at", lambda x: x < F.col("v")))).alias("cell"))
    lower, upper = F.expr("(n - 1) div 2"), F.expr("n div 2")
    cells = inside.groupBy("c", "cell").agg(F.sum("m").alias("own"), F.first("n").alias("n"))
    before = F.sum("own").over(Window.partitionBy("c").orderBy("cell")) - F.col("own")
    cells = cells.withColumn("before", before).filter((F.col("before") <= upper) & (lower < F.col("before") + F.col("own")))
    ranked = inside.join(F.broadcast(cells.select("c", "cell", "before")), ["c", "cell"])
    ranked = ranked.withColumn("upto", F.col("before") + F.sum("m").over(Window.partitionBy("c", "cell").orderBy("v")))
    holds = lambda k: ((F.col("upto") - F.col("m") <= k) & (k < F.col("upto"))).cast("int")
    found = ranked.groupBy("c").agg((F.sum(F.col("v") * (holds(lower) + holds(upper))) / 2).alias("median"))
    return found.agg(*[F.max(F.when(F.col("c") == i, F.col("median"))).alias(f"median_{c}") for i, c in enumerate(cols)])


def fit_imputer(df: DataFrame, cols) -> dict:
    """Median for numeric columns, smallest most-frequent value for the others."""
    num = _numeric(df, cols)
    other = [c for c in cols if c not in num]
    out = {}
    if num:
        row = medians(df, num).first()
        out.update({c: row[f"median_{c}"] for c in num})
    if other:
        out.update(df.agg(*[F.mode(c, deterministic=True).alias(c) for c in other]).first().asDict())
    return {c: out[c] for c in cols}


def apply_imputer(df: DataFrame, state: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in state.items()
                           if c in df.columns and v is not None})


# -- M1: label encode ------------------------------------------------------------
def fit_label_encoder(df: DataFrame, cols) -> dict:
    """Alphabetical index per column (StringIndexer alphabetAsc); the labels are
    the frozen state (bounded by category cardinality)."""
    state = {}
    for c in cols:
        if c not in df.columns:
            state[c] = []
            continue
        m = StringIndexer(inputCol=c, outputCol=c + "__i", stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df.select(c))
        state[c] = list(m.labels)
    return state


def apply_label_encoder(df: DataFrame, state: dict, suffix: str = "_idx") -> DataFrame:
    """Seen label -> its alphabetical index, unseen or null -> -1, absent column -> -1.

    Labels are joined as a (label, index) table, which Spark broadcasts only
    when its size allows."""
    out = {}
    for c, labels in state.items():
        if c not in df.columns or not labels:
            out[c + suffix] = F.lit(-1)
            continue
        vocab = df.sparkSession.createDataFrame(list(enumerate(labels)), f"{c}__i int, {c}__l string")
        df = (df.join(vocab, F.col(c) == F.col(f"{c}__l"), "left")
              .withColumn(c + suffix, F.coalesce(F.col(f"{c}__i"), F.lit(-1)))
              .drop(f"{c}__i", f"{c}__l"))
    return df.withColumns(out)


# -- M4: which columns to scale ------------------------------------------------------------
def columns_to_scale(df: DataFrame, cols) -> dict:
    """More than two distinct values: pass 1 min/max of every column, pass 2 ``bool_or(v <> min AND v <> max)``."""
    cols = _numeric(df, cols)
    long = _long(df, cols)
    ends = long.groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    more = (long.join(F.broadcast(ends), "c").groupBy("c")
            .agg(F.bool_or((F.col("v") != F.col("lo")) & (F.col("v") != F.col("hi"))).alias("more")))
    flags = {r["c"]: r["more"] for r in more.collect()}  # a row per column
    return {c: bool(flags.get(i)) for i, c in enumerate(cols)}


# -- M3: standard scale with population std ------------------------------------------------
def fit_scaler(df: DataFrame, cols) -> dict:
    cols = list(cols)
    stats = _long(df, cols).groupBy("c").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    found = {r["c"]: (r["m"], r["s"]) for r in stats.collect()}  # a row per column
    return {c: found.get(i, (None, None)) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, state: dict) -> DataFrame:
    out = {}
    for c, (mean, std) in state.items():
        d = std if std not in (None, 0, 0.0) else 1.0
        out[c] = (F.col(c) - F.lit(mean)) / F.lit(d)
    return df.withColumns(out)


# -- M5: fitted pipeline ---------------------------------------------------------------------
@dataclass
class FeaturePipelineModel:
    impute: dict = field(default_factory=dict)
    encode: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        df = apply_imputer(df, self.impute)
        df = apply_label_encoder(df, self.encode)
        return apply_scaler(df, self.scale)

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @staticmethod
    def from_json(s: str) -> "FeaturePipelineModel":
        d = json.loads(s)
        return FeaturePipelineModel(d["impute"], d["encode"], {k: tuple(v) for k, v in d["scale"].items()})


def fit_pipeline(df: DataFrame, numeric_cols, categorical_cols) -> FeaturePipelineModel:
    imp = fit_imputer(df, list(numeric_cols) + list(categorical_cols))
    filled = apply_imputer(df, imp)
    enc = fit_label_encoder(filled, categorical_cols)
    coded = apply_label_encoder(filled, enc)
    # Encoded columns are numbers like any other: scaled if they have more than two values.
    to_scale = [c for c, ok in columns_to_scale(coded, [*numeric_cols, *(c + "_idx" for c in enc)]).items() if ok]
    return FeaturePipelineModel(imp, enc, fit_scaler(coded, to_scale))


# ---------------------------------------------------------------------------
# Lazy plan forms: statistics stay a one-row DataFrame attached as a scalar
# subquery, so a query runs no action while it is being built (M1's vocabulary
# is the exception: it is written once).
# ---------------------------------------------------------------------------
def _attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    return with_stats(df, stats)


def impute_plan(df: DataFrame, numeric_cols, categorical_cols=()) -> tuple[DataFrame, DataFrame]:
    """M2: (imputed frame, one-row statistics frame)."""
    stats = medians(df, numeric_cols)
    if categorical_cols:
        stats = _attach(stats, df.agg(*[F.mode(c, deterministic=True).alias(f"mode_{c}") for c in categorical_cols]))
    j = _attach(df, stats)
    fills = {c: F.coalesce(F.col(c), F.col(f"median_{c}")) for c in numeric_cols}
    fills.update({c: F.coalesce(F.col(c), F.col(f"mode_{c}")) for c in categorical_cols})
    return j.withColumns(fills).drop(*stats.columns), stats


def scale_plan(df: DataFrame, cols) -> DataFrame:
    """M3: (x - mean) / population std; a zero (or undefined) std divides by 1."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = _attach(df, stats)
    out = {}
    for c in cols:
        s = F.col(f"_s_{c}")
        out[c] = (F.col(c) - F.col(f"_m_{c}")) / F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)
    return j.withColumns(out).drop(*stats.columns)


def scale_columns_plan(df: DataFrame, cols) -> DataFrame:
    """M4 as rows (column, scale): more than two distinct values."""
    mm = df.agg(*[F.min(c).alias(f"_mn_{c}") for c in cols], *[F.max(c).alias(f"_mx_{c}") for c in cols])
    j = _attach(df.select(*cols), mm)
    flags = j.agg(*[F.coalesce(F.bool_or((F.col(c) != F.col(f"_mn_{c}")) & (F.col(c) != F.col(f"_mx_{c}"))),
                               F.lit(False)).alias(c) for c in cols])
    stack = "stack({}, {}) AS (column_name, scale)".format(len(cols), ", ".join(f"'{c}', `{c}`" for c in cols))
    return flags.selectExpr(stack)


def vocabulary(df: DataFrame, cols, ranges: int | None = None) -> DataFrame:
    """(c, v, i): the distinct non-null values of each column and their alphabetical index from 0.

    The values are dealt to ranges, written once (so a value's range stays the same), counted by range and
    ranked inside their range; no task holds a column's vocabulary.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(df.sparkSession)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    seen = df.select(pairs.alias("p")).select("p.*").filter(F.col("v").isNotNull()).distinct()
    seen = seen.repartitionByRange(ranges, "c", "v").withColumn("part", F.spark_partition_id()).checkpoint()
    parts = seen.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"))  # at most ``ranges`` rows and a few
    parts = parts.select("c", "part", (F.sum("n").over(Window.partitionBy("c").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("c", "part").orderBy("v")) - 1
    return seen.withColumn("inside", inside).join(parts, ["c", "part"]).select(
        "c", "v", (F.col("before") + F.col("inside")).cast("int").alias("i"))


def label_encode_plan(fit_df: DataFrame, df: DataFrame, cols, suffix: str = "_idx") -> DataFrame:
    """M1: alphabetical index of the values seen in ``fit_df``; unseen / null / absent column -> -1."""
    seen = [c for c in cols if c in fit_df.columns and c in df.columns]
    index = vocabulary(fit_df, seen) if seen else None
    out = df
    for c in cols:
        if c not in seen:
            out = out.withColumn(c + suffix, F.lit(-1))
            continue
        own = index.filter(F.col("c") == c).select(F.col("v").alias("_v"), F.col("i").alias("_i"))
        out = (out.join(own, F.col(c).cast("string") == F.col("_v"), "left")
               .withColumn(c + suffix, F.coalesce(F.col("_i"), F.lit(-1))).drop("_v", "_i"))
    return out
