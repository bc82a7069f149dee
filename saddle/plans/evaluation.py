"""Classifying vertices by their embeddings: folds, repeated splits, grids of data sets.

Data sets are tables ``(id, v array<double>, y int)`` with classes 0, 1, ...; rows without a class are left out. Linear
models of all folds, repetitions, training shares and data sets are fitted together (``operators/linear.py``). Forests run as Spark ML jobs.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saddle.functions.uniform import uniform
from saddle.operators import linear
from saddle.operators.linear import Linear
from saddle.operators.metrics import confusion_counts, f1_macro_micro, kind_counts, topn_multilabel
from saddle.operators.splits import kfold, stratified_kfold
from saddle.skew import grouped_rank, lookup_join
from saddle.storage import materialise

PARALLEL_FITS = 4


@dataclass(frozen=True)
class Forest:
    depth: int = 2
    trees: int = 50
    features: str = "0.1"

    def fit(self, train: DataFrame):
        model = RandomForestClassifier(featuresCol="_f", labelCol="_y", maxDepth=self.depth, numTrees=self.trees, impurity="entropy",
                                       featureSubsetStrategy=self.features, seed=1)
        return model.fit(train.withColumn("_f", array_to_vector("v")).withColumn("_y", F.col("labels")[0].cast("double")))


Classifier = Linear | Forest

# fixed values: the classifiers' settings
CLASSIFIERS: dict[str, Classifier] = {
    "logistic_l2": Linear(c=0.005),
    "logistic_l1": Linear(c=0.1, l1=True),
    "logistic_multinomial": Linear(c=1.8, multinomial=True),
    "one_vs_rest": Linear(c=1.8),
    "random_forest": Forest(depth=2),
    "random_forest_deep": Forest(depth=5),
}


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def numbered(datasets: dict[str, DataFrame]) -> DataFrame:
    """``(ds, id, v, labels)`` of all data sets, numbered in their order."""
    return _all([d.where("y IS NOT NULL").select(F.lit(i).alias("ds"), "id", "v", F.array(F.col("y").cast("int")).alias("labels")) for i, d in enumerate(datasets.values())])


def _named(names: list[str], column: str) -> Column:
    return F.array(*[F.lit(name) for name in names])[F.col(column)]


def _classes(rows: DataFrame) -> int:
    """One more than the largest label."""
    return (rows.agg(F.max(F.array_max("labels"))).first()[0] or 0) + 1


def _predictions(rows: DataFrame, specs: dict[str, Classifier], classes: int) -> DataFrame:
    """``(ds, model, fit, id, y, pred, p)`` for ``rows`` with the columns of ``linear.COLUMNS``."""
    names, parts = list(specs), []
    lines = [n for n in names if isinstance(specs[n], Linear)]
    held = linear.Rows(rows, classes)
    if lines:
        own = [specs[n] for n in lines]
        found = linear.predictions(held, own, linear.fit(held, own))
        parts.append(found.withColumn("model", F.array(*[F.lit(n) for n in lines])[F.col("model")]))
    jobs = [(n, ds, j) for n in names if n not in lines for ds, (_, fits) in held.shapes.items() for j in range(fits)]

    def one(job: tuple[str, int, int]) -> DataFrame:
        name, ds, j = job
        mine = held.table.where(F.col("ds") == ds)
        model = specs[name].fit(mine.where(F.col("train")[j]))
        out = model.transform(mine.where(F.col("test")[j]).withColumn("_f", array_to_vector("v")))
        pred = F.col("prediction").cast("int")
        return out.select("ds", F.lit(name).alias("model"), F.lit(j).alias("fit"), "id", F.col("labels")[0].alias("y"), pred.alias("pred"),
                          vector_to_array("probability")[pred].alias("p"))

    if jobs:
        with ThreadPool(PARALLEL_FITS) as pool:
            parts += pool.map(one, jobs)
    return _all(parts)


def _scores(cells: DataFrame, by: list[str]) -> DataFrame:
    """Macro and micro F1 of ``(by, y, pred, n)``."""
    return f1_macro_micro(kind_counts(cells, by), by)


# -- folds ---------------------------------------------------------------------------------

def fold_marks(k: int) -> list[Column]:
    """``train`` and ``test`` of k folds and, as fit k, of learning from everything and judging on it."""
    fold = F.col("fold")
    return [F.array(*[fold != i for i in range(k)], F.lit(True)).alias("train"), F.array(*[fold == i for i in range(k)], F.lit(True)).alias("test")]


def cross_val_predict(folded: DataFrame, spec: Classifier, k: int) -> DataFrame:
    """For every row of ``(id, v, y, fold)`` the prediction and its share by the model that has not seen it: ``(id, y, fold, pred, p)``."""
    rows = folded.where("y IS NOT NULL").select(F.lit(0).alias("ds"), "id", "v", F.array(F.col("y").cast("int")).alias("labels"),
                                                F.array(*[F.col("fold") != i for i in range(k)]).alias("train"),
                                                F.array(*[F.col("fold") == i for i in range(k)]).alias("test"))
    out = _predictions(rows, {"": spec}, _classes(rows))
    return out.select("id", "y", F.col("fit").alias("fold"), "pred", "p")


def cross_validate_all(datasets: dict[str, DataFrame], classifiers: dict[str, Classifier], k: int, folds: DataFrame) -> DataFrame:
    """``(dataset, model, fold, macro, micro)`` over ``folds(id, fold)``; fold ``k`` holds the score on the training rows."""
    rows = lookup_join(numbered(datasets), folds, "id").select("ds", "id", "v", "labels", *fold_marks(k))
    found = _predictions(rows, classifiers, _classes(rows))
    cells = found.groupBy("ds", "model", "fit", "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    return _scores(cells, ["ds", "model", "fit"]).select(_named(list(datasets), "ds").alias("dataset"), "model", F.col("fit").alias("fold"), "macro", "micro")


def cross_validate(folded: DataFrame, spec: Classifier, k: int, name: str) -> DataFrame:
    """``(model, fold, macro, micro)`` of ``(id, v, y, fold)``; fold ``k`` holds the score on the training rows."""
    return cross_validate_all({"": folded.select("id", "v", "y")}, {name: spec}, k, folded.select("id", "fold")).drop("dataset")


def run_all_datasets(datasets: dict[str, DataFrame], classifiers: dict[str, Classifier], k: int) -> DataFrame:
    """Every classifier on every data set; all data sets share the folds of their rows."""
    classes = _all([d.where("y IS NOT NULL").select("id", "y") for d in datasets.values()]).distinct()
    folds = materialise(stratified_kfold(classes, "y", "id", k).select("id", "fold"))
    return cross_validate_all(datasets, classifiers, k, folds)


# -- multi-label ---------------------------------------------------------------------------

def _multilabel_rows(data: DataFrame, truth: DataFrame, train: Column, test: Column) -> DataFrame:
    """Rows without any label are negatives of every label."""
    # at most one entry a label
    wide = truth.groupBy("id").agg(F.collect_set(F.col("label").cast("int")).alias("labels"))
    none = F.array().cast("array<int>")
    return data.join(wide, "id", "left").select(F.lit(0).alias("ds"), "id", "v", F.coalesce("labels", none).alias("labels"), train.alias("train"), test.alias("test"))


def one_vs_rest_scores(data: DataFrame, truth: DataFrame, classes: int, spec: Linear) -> DataFrame:
    """``(id, label, p)``: one binary model per label 0, 1, ... of the long table ``truth(id, label)``, learnt from all rows of ``data(id, v)``."""
    rows = linear.Rows(_multilabel_rows(data, truth, F.array(F.lit(True)), F.array(F.lit(True))), classes)
    return linear.label_scores(rows, spec, linear.fit(rows, [spec])).select("id", "label", "p")


def cross_validate_multilabel(data: DataFrame, truth: DataFrame, classes: int, spec: Linear, k: int, name: str = "one_vs_rest") -> DataFrame:
    """``(model, fold, macro, micro)`` predicting as many labels as each row truly has; fold ``k`` holds the score on the training rows."""
    rows = linear.Rows(_multilabel_rows(materialise(kfold(data, "id", k)), truth, *fold_marks(k)), classes)
    scores = materialise(linear.label_scores(rows, spec, linear.fit(rows, [spec])))
    parts = []
    for i in range(k + 1):
        own = scores.where(F.col("fit") == i).select("id", "label", "p")
        held = truth.join(own.select("id").distinct(), "id", "left_semi")
        scored = f1_macro_micro(confusion_counts(held, topn_multilabel(own, held)))
        parts.append(scored.select(F.lit(name).alias("model"), F.lit(i).alias("fold"), "macro", "micro"))
    return _all(parts)


# -- repeated splits -----------------------------------------------------------------------

def _entries(lists: Column, at: int) -> Column:
    return F.transform(lists, lambda x: x[at])


def split_marks(classes: DataFrame, shares: list[float], reps: int, stratify: bool = True) -> DataFrame:
    """``(id, train, test)`` of ``(id, y)``: fit s * reps + r is share s in repetition r, the last learns from all rows and judges them.

    A repetition deals all its shares from one random order, so a larger share holds a smaller one's rows. Classes keep their
    share (``round``); a share that leaves a class without rows on one side is dealt over all rows.
    """
    uniforms = F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), uniform(f"{'split' if stratify else 'mask'}-{r}", "id").alias("u")) for r in range(reps)]))
    drawn = classes.select("id", "y", uniforms.alias("d")).select("id", "y", "d.rep", "d.u")
    if stratify:
        counts = classes.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
        facts = counts.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
        whole = [int(round(s * (facts["n"] or 0), 9)) for s in shares]
        mixed = [(facts["least"] or 0) < 2 or min(w, facts["n"] - w) < facts["classes"] for w in whole]
        ranked = drawn
        if not all(mixed):
            ranked = lookup_join(grouped_rank(ranked, ["rep", "y"], [F.col("u"), F.col("id")], "inside", 0), counts, "y")
        if any(mixed):
            ranked = grouped_rank(ranked, ["rep"], [F.col("u"), F.col("id")], "overall", 0)
        marks = [F.col("overall") < w if m else F.col("inside") < F.round(F.round(F.col("n") * F.lit(s), 9)).cast("bigint") for s, w, m in zip(shares, whole, mixed)]
    else:
        ranked, marks = drawn, [F.col("u") < F.lit(s) for s in shares]
    # one entry a repetition
    held = ranked.select("id", "rep", F.array(*marks).alias("m")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rep", "m"))).alias("all"))
    marked = F.transform("all", lambda x: x["m"])
    train = F.flatten(F.array(*[_entries(marked, s) for s in range(len(shares))]))
    last = F.array(F.lit(True))
    return held.select("id", F.concat(train, last).alias("train"), F.concat(F.transform(train, lambda x: ~x), last).alias("test"))


def holdout_scores(datasets: dict[str, DataFrame], spec: Linear, reps: int, shares: list[float], stratify: bool = True) -> DataFrame:
    """``(model, share, rep, macro, micro)``; rep -1 is the fit on everything (share null). Repetitions share their split across data sets."""
    return holdout_rows(numbered(datasets), list(datasets), spec, reps, shares, stratify)


def holdout_rows(rows: DataFrame, names: list[str], spec: Linear, reps: int, shares: list[float], stratify: bool = True) -> DataFrame:
    """As ``holdout_scores`` for data sets that are numbered already: ``rows(ds, id, v, labels)``."""
    rows = materialise(rows)
    classes = materialise(rows.select("id", F.col("labels")[0].alias("y")).distinct())
    marks = split_marks(classes, shares, reps, stratify)
    held = linear.Rows(lookup_join(rows, marks, "id"), _classes(rows))
    cells = linear.outcomes(held, [spec], linear.fit(held, [spec]))
    last = len(shares) * reps
    place = F.floor(F.col("fit") / reps).cast("int")
    return _scores(cells, ["ds", "fit"]).select(
        _named(names, "ds").alias("model"), F.when(F.col("fit") < last, F.array(*[F.lit(s) for s in shares])[F.least(place, F.lit(len(shares) - 1))]).alias("share"),
        F.when(F.col("fit") < last, F.col("fit") % reps).otherwise(-1).alias("rep"), "macro", "micro")


def summary_with_error(scores: DataFrame) -> DataFrame:
    """Long ``(model, share, mean, sde, train)``: mean and standard error over repetitions, and the training score."""
    train = scores.where("rep < 0").select("model", F.col("macro").alias("train"))
    per = scores.where("rep >= 0").groupBy("model", "share").agg(F.avg("macro").alias("mean"), (F.stddev_samp("macro") / F.sqrt(F.count("macro"))).alias("sde"))
    return per.join(train, "model").select("model", "share", "mean", "sde", "train")


def repeated_holdout(datasets: dict[str, DataFrame], spec: Linear, reps: int, share: float = 0.8, stratify: bool = True) -> DataFrame:
    return summary_with_error(holdout_scores(datasets, spec, reps, [share], stratify)).drop("share")


def train_share_curve(datasets: dict[str, DataFrame], spec: Linear, shares: list[float], reps: int) -> DataFrame:
    """Long ``(model, share, mean, sde, train)`` of all shares and repetitions, fitted together."""
    return summary_with_error(holdout_scores(datasets, spec, reps, shares))


def curve_matrix(curve: DataFrame, shares: list[float], value: str = "mean") -> DataFrame:
    """One column per training share."""
    return curve.groupBy("model").pivot("share", shares).agg(F.first(value))


def transfer(train: DataFrame, test: DataFrame, spec: Linear) -> DataFrame:
    """Fit on one embedding and score on another: ``(macro, micro)``."""
    sides = [d.where("y IS NOT NULL").select(F.lit(0).alias("ds"), "id", "v", F.array(F.col("y").cast("int")).alias("labels"),
                                             F.array(F.lit(learn)).alias("train"), F.array(F.lit(not learn)).alias("test")) for d, learn in ((train, True), (test, False))]
    rows = _all(sides)
    held = linear.Rows(rows, _classes(rows))
    return _scores(linear.outcomes(held, [spec], linear.fit(held, [spec])), ["ds"]).drop("ds")
