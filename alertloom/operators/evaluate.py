"""Detection-quality metrics as Spark aggregates.

Inputs are a DataFrame with a 0/1 label, a score and (for ordered metrics) a unique row id.

* ROC-AUC and average precision work on the score histogram (one row per distinct score); the
  "how many lie below this score" counts come from a bounded table of score-range totals
  (``bins`` rows, broadcast) plus a running sum inside each range.
* FPR at a recall target finds the stopping row with exact order statistics
  (:func:`alertloom.operators.ordering.kth_smallest`), then counts with one aggregate.
* Detection latency numbers rows globally (range partitioning on a unique key), finds episode
  starts with an in-chunk ``lag`` and episode ids with an exact chunked running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.config import FPR_RECALL_TARGETS
from alertloom.operators.ordering import chunked, global_row_number, kth_smallest, running_sum


# ------------------------------------------------------------------------------ confusion

def confusion_metrics(df: DataFrame, label: str = "y_true", score: str = "y_score", threshold: float = 0.5,
                      pred: str | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and FPR (0 where undefined); with
    ``group_by`` one row per group (A26, e.g. per model)."""
    y = F.col(label)
    p = F.col(pred) if pred else (F.col(score) >= F.lit(threshold)).cast("int")
    cnt = [F.count(F.when((y == 1) & (p == 1), 1)).alias("true_positives"),
           F.count(F.when((y == 0) & (p == 1), 1)).alias("false_positives"),
           F.count(F.when((y == 0) & (p == 0), 1)).alias("true_negatives"),
           F.count(F.when((y == 1) & (p == 0), 1)).alias("false_negatives")]
    agg = df.groupBy(*group_by).agg(*cnt) if group_by else df.agg(*cnt)
    tp, fp, tn, fn = (F.col(c).cast("double") for c in
                      ("true_positives", "false_positives", "true_negatives", "false_negatives"))

    def safe(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(num, F.when(den > 0, den)), F.lit(0.0))

    return agg.select(*group_by, "true_positives", "false_positives", "true_negatives", "false_negatives",
                      safe(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                      safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
                      safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(fp, fp + tn).alias("fpr"))


# ------------------------------------------------------------------------------ score histogram

def ranked_histogram(df: DataFrame, label: str = "y_true", score: str = "y_score", bins: int = 1024) -> DataFrame:
    """One row per distinct score: ``s, p, n`` (positives/negatives at s), ``p_lt, n_lt``
    (strictly below s) and the class totals ``tot_pos, tot_neg``."""
    hist = (df.where(F.col(score).isNotNull())
            .groupBy(F.col(score).cast("double").alias("s"))
            .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"),
                 F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n")))
    st = hist.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    lo = float(st["lo"]) if st and st["lo"] is not None else 0.0
    hi = float(st["hi"]) if st and st["hi"] is not None else 0.0
    width = hi / bins - lo / bins
    b = (F.least(F.floor((F.col("s") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
         if width > 0 else F.lit(0))
    hist = hist.withColumn("_b", b)
    tot = hist.groupBy("_b").agg(F.sum("p").alias("_bp"), F.sum("n").alias("_bn"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most `bins` rows: broadcast is bounded by the bin count, not by the data
    offs = tot.select("_b", F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_op"),
                      F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_on"),
                      F.sum("_bp").over(whole).alias("tot_pos"), F.sum("_bn").over(whole).alias("tot_neg"))
    inb = Window.partitionBy("_b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return (hist.join(F.broadcast(offs), "_b")
            .withColumn("p_lt", F.col("_op") + F.coalesce(F.sum("p").over(inb), F.lit(0)))
            .withColumn("n_lt", F.col("_on") + F.coalesce(F.sum("n").over(inb), F.lit(0)))
            .select("s", "p", "n", "p_lt", "n_lt", "tot_pos", "tot_neg"))


def roc_auc(df: DataFrame, label: str = "y_true", score: str = "y_score") -> DataFrame:
    """ROC-AUC with ties counted half; 0.0 when only one class is present."""
    h = ranked_histogram(df, label, score)
    a = h.agg(F.sum(F.col("p") * (F.col("n_lt") + 0.5 * F.col("n"))).alias("_num"),
              F.first("tot_pos").alias("_P"), F.first("tot_neg").alias("_N"))
    return a.select(F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                           F.col("_num") / (F.col("_P").cast("double") * F.col("_N"))).otherwise(0.0).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "y_true", score: str = "y_score") -> DataFrame:
    """Step-sum average precision ``sum (R_k - R_{k-1}) P_k`` over distinct thresholds,
    ties included; 0.0 without positives."""
    h = ranked_histogram(df, label, score)
    tp = F.col("tot_pos") - F.col("p_lt")
    fp = F.col("tot_neg") - F.col("n_lt")
    a = h.agg(F.sum(F.when(F.col("p") > 0, F.col("p") * tp / (tp + fp))).alias("_num"),
              F.first("tot_pos").alias("_P"))
    return a.select(F.when(F.col("_P") > 0, F.coalesce(F.col("_num"), F.lit(0.0)) / F.col("_P"))
                    .otherwise(0.0).alias("pr_auc"))


# ------------------------------------------------------------------------------ FPR at recall

def _class_totals(df: DataFrame, label: str) -> tuple[int, int]:
    r = df.agg(F.count(F.when(F.col(label) == 1, 1)).alias("P"),
               F.count(F.when(F.col(label) != 1, 1)).alias("N")).first()
    return int(r["P"]), int(r["N"])


def fpr_at_recall(df: DataFrame, target: float, label: str = "y_true", score: str = "y_score",
                  id_col: str = "id") -> DataFrame:
    """Walk rows by score (desc), then id (asc); stop at the first row where the true
    positives reach ``int(target * P)`` (the first row is always taken); FPR of the rows walked.
    0.0 when a class is absent. One-row DataFrame ``fpr``."""
    P, N = _class_totals(df, label)
    spark = df.sparkSession
    if P == 0 or N == 0:
        return spark.range(1).select(F.lit(0.0).alias("fpr"))
    t = int(target * P)
    neg = F.col(label) != 1
    if t == 0:
        top = df.agg(F.max(score).alias("m")).first()["m"]
        first_id = df.where(F.col(score) == F.lit(top)).agg(F.min(id_col).alias("i")).first()["i"]
        stop = (F.col(score) == F.lit(top)) & (F.col(id_col) == F.lit(first_id))
        return df.agg((F.count(F.when(stop & neg, 1)) / F.lit(float(N))).alias("fpr"))
    pos = df.where(F.col(label) == 1)
    # the t-th positive in walk order: its score is the t-th largest positive score ...
    s_t = -kth_smallest(pos, -F.col(score).cast("double"), t)
    above = pos.where(F.col(score) > F.lit(s_t)).count()
    # ... and among positives tied at that score it is the (t - above)-th smallest id
    id_t = kth_smallest(pos.where(F.col(score) == F.lit(s_t)), F.col(id_col), t - above)
    walked_neg = neg & ((F.col(score) > F.lit(s_t)) | ((F.col(score) == F.lit(s_t)) & (F.col(id_col) < F.lit(id_t))))
    return df.agg((F.count(F.when(walked_neg, 1)) / F.lit(float(N))).alias("fpr"))


def fpr_at_recall_curve(df: DataFrame, target: float = 0.95, label: str = "y_true", score: str = "y_score",
                        fallback_threshold: float = 0.5) -> DataFrame:
    """On the precision-recall curve (thresholds = distinct scores from the smallest
    positive score up), take the smallest threshold whose recall is at most ``target``
    (fallback 0.5 when none) and return ``fpr`` and ``threshold`` of ``score >= threshold``."""
    P, N = _class_totals(df, label)
    spark = df.sparkSession
    if P == 0 or N == 0:
        return spark.range(1).select(F.lit(0.0).alias("fpr"), F.lit(None).cast("double").alias("threshold"))
    # recall(s) = P_ge(s) / P is at most target iff at least m positives lie strictly below s
    m = max(0, int(P * (1 - target)) - 2)
    while (P - m) / P > target:
        m += 1
    pos = df.where(F.col(label) == 1).select(F.col(score).cast("double").alias("_s"))
    if m == 0:
        thr = pos.agg(F.min("_s")).first()[0]
    else:
        v_m = kth_smallest(pos, "_s", m)
        thr = df.where(F.col(score) > F.lit(v_m)).agg(F.min(F.col(score).cast("double"))).first()[0]
    if thr is None:
        thr = fallback_threshold
    return df.agg((F.count(F.when((F.col(label) != 1) & (F.col(score) >= F.lit(thr)), 1))
                   / F.lit(float(N))).alias("fpr"), F.lit(float(thr)).alias("threshold"))


# ------------------------------------------------------------------------------ detection latency

def detection_latency(df: DataFrame, label: str = "y_true", score: str = "y_score", threshold: float = 0.5,
                      order: Sequence[str] = ("ts", "id"), chunk_rows: int = 1 << 20) -> DataFrame:
    """Attack episodes are maximal runs of label 1 in ``order``; an episode is detected at
    the first row from its start whose prediction is 1, scanning up to and including the first
    normal row after it (Q7). Latency is in rows. One row: mean, median, p95, detection rate,
    detected and total episodes (zeros when nothing is detected)."""
    base = df.select(*order, F.col(label).alias("_y"),
                     (F.col(score) >= F.lit(threshold)).cast("int").alias("_p"))
    numbered = global_row_number(base, list(order))
    ch = chunked(numbered, chunk_rows, 1)
    w = Window.partitionBy("_chunk").orderBy("_rn")
    flagged = (ch.withColumn("_prev", F.lag("_y").over(w))
               .withColumn("_start", ((F.col("_y") == 1) & (F.coalesce(F.col("_prev"), F.lit(0)) != 1)).cast("int")))
    with_ep = running_sum(flagged, "_start", "_ep")
    eligible = (F.col("_y") == 1) | (F.col("_prev") == 1)
    per_ep = (with_ep.where(eligible & (F.col("_ep") > 0))
              .groupBy("_ep")
              .agg(F.min(F.when(F.col("_start") == 1, F.col("_rn"))).alias("_s"),
                   F.min(F.when(F.col("_p") == 1, F.col("_rn"))).alias("_d")))
    lat = (F.col("_d") - F.col("_s")).cast("double")
    a = per_ep.agg(F.count(F.lit(1)).alias("attacks_total"), F.count(F.col("_d")).alias("attacks_detected"),
                   F.avg(lat).alias("_mean"), F.percentile(lat, F.lit(0.5)).alias("_med"),
                   F.percentile(lat, F.lit(0.95)).alias("_p95"))
    found = F.col("attacks_detected") > 0
    return a.select(F.when(found, F.col("_mean")).otherwise(0.0).alias("mean_latency_windows"),
                    F.when(found, F.col("_med")).otherwise(0.0).alias("median_latency_windows"),
                    F.when(found, F.col("_p95")).otherwise(0.0).alias("p95_latency_windows"),
                    F.when(found, F.col("attacks_detected") / F.col("attacks_total")).otherwise(0.0)
                    .alias("detection_rate"),
                    "attacks_detected", "attacks_total")


# ------------------------------------------------------------------------------ all metrics (long form)

def compute_metrics(df: DataFrame, label: str = "y_true", score: str = "y_score", id_col: str = "id",
                    threshold: float = 0.5, targets: Sequence[float] = FPR_RECALL_TARGETS) -> DataFrame:
    """The reference's metric dict as a long table ``(metric, value)``."""
    conf = confusion_metrics(df, label, score, threshold)
    names = ["accuracy", "precision", "recall", "f1", "fpr", "true_positives", "false_positives",
             "true_negatives", "false_negatives"]
    parts = [conf.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double")
                                                      .alias("value")) for n in names])).alias("m"))
             .select("m.metric", "m.value")]
    parts.append(roc_auc(df, label, score).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))
    parts.append(average_precision(df, label, score).select(F.lit("pr_auc").alias("metric"),
                                                            F.col("pr_auc").alias("value")))
    for t in targets:
        parts.append(fpr_at_recall(df, t, label, score, id_col)
                     .select(F.lit(f"fpr_at_{int(round(t * 100))}_recall").alias("metric"), F.col("fpr").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
