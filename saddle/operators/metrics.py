"""Classification scores, significance tests and result tables."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saddle.ordering import running_total
from saddle.skew import grouped_rank


def argmax_predict(df: DataFrame, probs: str = "probs", out: str = "pred") -> DataFrame:
    return df.withColumn(out, (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))


def confusion_single(df: DataFrame, by: list[str] | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """tp, fp, fn per class from one ``(y, pred)`` row per example; counted before the shuffle."""
    by = by or []
    return kind_counts(df.groupBy(*by, y, pred).agg(F.count(F.lit(1)).alias("n")), by, y, pred)


def kind_counts(cells: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """tp, fp, fn per class from counted cells ``(by, y, pred, n)``."""
    marks = F.when(F.col(y) == F.col(pred), F.array(F.struct(F.col(y).alias("label"), F.lit("tp").alias("kind")))).otherwise(
        F.array(F.struct(F.col(y).alias("label"), F.lit("fn").alias("kind")),
                F.struct(F.col(pred).alias("label"), F.lit("fp").alias("kind"))))
    long = cells.select(*by, "n", F.explode(marks).alias("m")).select(*by, "n", "m.*")
    return _count_kinds(long, by)


def confusion_counts(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn per label from long ``(id, label)`` tables; one shuffle of their union."""
    both = truth.select("id", "label", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        predicted.select("id", "label", F.lit(0).alias("t"), F.lit(1).alias("p")))
    cells = both.groupBy("id", "label").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    kind = F.when((F.col("t") == 1) & (F.col("p") == 1), "tp").when(F.col("p") == 1, "fp").otherwise("fn")
    return _count_kinds(cells.select("label", kind.alias("kind"), F.lit(1).cast("bigint").alias("n")), [])


def _count_kinds(long: DataFrame, by: list[str]) -> DataFrame:
    return long.groupBy(*by, "label").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("bigint").alias(k)
          for k in ("tp", "fp", "fn")])


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns({
        "precision": ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn")),
        "f1": ratio(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def f1_macro_micro(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro F1 = mean over classes; micro F1 from the pooled counts."""
    pooled = F.lit(2) * F.sum("tp") + F.sum("fp") + F.sum("fn")
    return class_scores(counts).groupBy(*(by or [])).agg(
        F.avg("f1").alias("macro"),
        F.coalesce(F.try_divide(F.lit(2.0) * F.sum("tp"), pooled), F.lit(0.0)).alias("micro"))


def topn_multilabel(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """For each id as many labels as it truly has, the most probable first (ties: smaller label)."""
    wanted = truth.groupBy("id").agg(F.count(F.lit(1)).alias("_k"))
    ranked = grouped_rank(scores, ["id"], [F.col("p").desc(), F.col("label")], "_r", 1)
    return ranked.join(wanted, "id").where("_r <= _k").select("id", "label")


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counting half, from counts per distinct score."""
    per = df.groupBy(score).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("all"))
    per = per.withColumn("neg", F.col("all") - F.col("pos"))
    run = running_total(per, "neg", [score], "upto")
    # whole numbers keep the sum exact: count every comparison twice
    wins = F.col("pos") * (F.lit(2) * (F.col("upto") - F.col("neg")) + F.col("neg"))
    return run.agg(F.try_divide(F.sum(wins), F.lit(2.0) * F.sum("pos") * F.sum("neg")).alias("auc"))


# -- result tables -------------------------------------------------------------------------

def merge_results(tables: list[DataFrame], n_folds: int) -> DataFrame:
    """Stack ``(model, fold, macro, micro)`` tables; the fold past the last holds training scores."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.select("model", F.when(F.col("fold") == n_folds, "train").otherwise(F.col("fold").cast("string"))
                      .alias("fold"), "macro", "micro")


def results_ranked(results: DataFrame, score: str = "macro") -> DataFrame:
    """Mean per model without the training column, best first."""
    means = results.where("fold <> 'train'").groupBy("model").agg(F.avg(score).alias("mean"))
    return means.orderBy(F.col("mean").desc(), "model")


def t_test_paired(results: DataFrame, score: str = "macro") -> DataFrame:
    """Paired two-sided t for every two models: ``(a, b, t, df)``.

    The table holds one row per model and fold, so its self-join is models squared.
    """
    rows = results.where("fold <> 'train'")
    a = rows.select("fold", F.col("model").alias("a"), F.col(score).alias("sa"))
    b = rows.select("fold", F.col("model").alias("b"), F.col(score).alias("sb"))
    gap = a.join(b, "fold").where("a < b").withColumn("g", F.col("sa") - F.col("sb"))
    moments = gap.groupBy("a", "b").agg(F.avg("g").alias("m"), F.stddev_samp("g").alias("s"), F.count("g").alias("n"))
    return moments.select("a", "b", F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")).alias("t"),
                          (F.col("n") - 1).cast("double").alias("df"))


def t_test_welch(results: DataFrame, score: str = "macro") -> DataFrame:
    """Welch t for every two models: ``(a, b, t, df)``."""
    per = results.where("fold <> 'train'").groupBy("model").agg(
        F.avg(score).alias("m"), F.var_samp(score).alias("v"), F.count(score).alias("n"))
    a = per.select(F.col("model").alias("a"), F.col("m").alias("ma"), F.col("v").alias("va"), F.col("n").alias("na"))
    b = per.select(F.col("model").alias("b"), F.col("m").alias("mb"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    df = F.try_divide((ea + eb) * (ea + eb), ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))
    return a.join(b, F.col("a") < F.col("b")).select(
        "a", "b", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb)).alias("t"), df.alias("df"))


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) through the regularised incomplete beta function (continued fraction)."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return _beta_share(df / 2.0, 0.5, df / (df + t * t))


def _beta_share(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """1 / (1 + d1/(1 + d2/(1 + ...))), evaluated from a deep term backwards."""
    value = 1.0
    for m in range(400, 0, -1):
        half, odd = divmod(m, 2)
        if odd:
            coefficient = -(a + half) * (a + b + half) * x / ((a + 2 * half) * (a + 2 * half + 1))
        else:
            coefficient = half * (b - half) * x / ((a + 2 * half - 1) * (a + 2 * half))
        value = 1.0 + coefficient / value
    return 1.0 / value


def with_p_value(tests: DataFrame) -> DataFrame:
    """Adds ``p``; null where the test is undefined."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        values = [student_t_two_sided(a, b) for a, b in zip(t, df)]
        return pd.Series([None if np.isnan(v) else v for v in values], dtype="float64")

    return tests.withColumn("p", p_value("t", "df"))


def results_summary(results: DataFrame, condition: str = "model") -> DataFrame:
    """Grand mean of both scores per condition."""
    return results.groupBy(condition).agg(F.avg("macro").alias("mean_macro"), F.avg("micro").alias("mean_micro"))


def mean_f1_all(results: DataFrame) -> DataFrame:
    """Mean macro F1 of each model over all data sets and training shares."""
    return results.groupBy("model").agg(F.avg("macro").alias("mean_macro"))
