"""ROC, thresholds and confusion counts of scored pairs (``y`` 0 or 1, ``s`` a score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ranks import number_bucket, running, with_medians


def roc(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """``threshold, tpr, fpr`` at each distinct score, falling. Rows are counted by score first."""
    levels = df.groupBy(F.col(s).cast("double").alias("threshold")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) == 0).cast("long")).alias("n"))
    out = running(levels, -number_bucket(F.col("threshold")), [F.desc("threshold")], {"tp": "p", "fp": "n"})
    return out.select("threshold", F.try_divide(F.col("tp") + F.col("p"), F.col("tp_all")).alias("tpr"), F.try_divide(F.col("fp") + F.col("n"), F.col("fp_all")).alias("fpr"))


def thresholds(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """One row: the threshold of equal error with its rate, and Youden's with its index; ties go to the higher threshold."""
    r = roc(df, y, s)
    gap, gain = F.abs(F.col("fpr") - (1 - F.col("tpr"))), F.col("tpr") - F.col("fpr")
    rate = (F.col("fpr") + 1 - F.col("tpr")) / 2
    a = F.min_by(F.struct("threshold", rate.alias("r")), F.struct(F.round(gap, 12), -F.col("threshold")))
    b = F.max_by(F.struct("threshold", gain.alias("g")), F.struct(F.round(gain, 12), "threshold"))
    return r.agg(a.alias("a"), b.alias("b")).select(F.col("a.threshold").alias("eer_threshold"), F.col("a.r").alias("eer"), F.col("b.threshold").alias("youden_threshold"), F.col("b.g").alias("youden"))


def auc(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """One row: positives, negatives and the area under the curve by average ranks; null with one class."""
    levels = df.groupBy(F.col(s).cast("double").alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.count("*").alias("k"))
    ranked = running(levels, number_bucket(F.col("s")), [F.col("s")], {"below": "k"}).withColumn("r", (F.col("below") + (F.col("k") + 1) / 2.0) * F.col("p"))
    one = ranked.agg(F.sum("p").alias("n_pos"), (F.sum("k") - F.sum("p")).alias("n_neg"), F.sum("r").alias("r"))
    area = F.try_divide(F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, F.col("n_pos") * F.col("n_neg"))
    return one.select("n_pos", "n_neg", area.alias("auc"))


def confusion(df: DataFrame, threshold, y: str = "y", s: str = "s") -> DataFrame:
    """One row: the four counts, accuracy, precision, recall, F1 (0 where undefined) at scores from the threshold up."""
    yes = F.col(s) >= threshold
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = df.agg(n(yes & (F.col(y) == 1)).alias("tp"), n(yes & (F.col(y) == 0)).alias("fp"), n(~yes & (F.col(y) == 1)).alias("fn"), n(~yes & (F.col(y) == 0)).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return one.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def holdout(df: DataFrame, key: list[str], truth: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy and support of predicted roles on held-out rows."""
    hit = F.col(truth) == F.col(predicted)
    per = df.groupBy(truth).agg(F.count("*").alias("n"), F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias("k"))
    return per.agg(F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("accuracy"), F.avg(F.col("k") / F.col("n")).alias("balanced_accuracy"), F.count("*").alias("n_classes"))


def confusion_by_class(df: DataFrame, truth: str, predicted: str, classes: tuple[str, ...] = ("AGENT", "CLIENT")) -> DataFrame:
    """``truth, predicted, n`` for every pair of classes, 0 where none; rows of other or missing classes are left out."""
    every = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "truth string, predicted string")
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def by_class(df: DataFrame, truth: str, predicted: str, classes: tuple[str, ...] = ("AGENT", "CLIENT")) -> DataFrame:
    """``role, precision, recall, f1, support`` of each class, in one pass over the rows that have a prediction; 0 where a share has no rows."""
    known = df.filter(F.col(predicted).isNotNull())
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    t, p = F.col(truth), F.col(predicted)
    one = known.agg(*[F.struct(F.lit(c).alias("role"), n((t == c) & (p == c)).alias("hit"), n(p == c).alias("said"), n(t == c).alias("support")).alias(f"__{i}") for i, c in enumerate(classes)])
    rows = one.select(F.explode(F.array(*[f"__{i}" for i in range(len(classes))])).alias("x")).select("x.*")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select("role", share(F.col("hit"), F.col("said")).alias("precision"), share(F.col("hit"), F.col("support")).alias("recall"), share(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


def open_set_metrics(df: DataFrame) -> DataFrame:
    """One row of identification, false rejection, false acceptance and overall rates of open-set decisions."""
    known, yes = F.col("truth_known"), F.col("decision") == "KNOWN"
    n = lambda c: F.sum(c.cast("long"))
    one = df.agg(n(known).alias("n_known"), n(~known).alias("n_unknown"), n(known & F.col("correct")).alias("identified"), n(known & ~yes).alias("rejected"), n(~known & yes).alias("accepted"), n(F.col("correct")).alias("right"))
    rate = lambda a, b: F.try_divide(F.col(a), b)
    return one.select("n_known", "n_unknown", rate("identified", F.col("n_known")).alias("identification_rate"), rate("rejected", F.col("n_known")).alias("false_rejection_rate"), rate("accepted", F.col("n_unknown")).alias("false_acceptance_rate"), rate("right", F.col("n_known") + F.col("n_unknown")).alias("overall_accuracy"))


def pair_summary(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """Count, mean and median score of each label."""
    return with_medians(df.groupBy(y).agg(F.count("*").alias("n"), F.avg(s).alias("mean_score")), df, {s: "median_score"}, [y])
