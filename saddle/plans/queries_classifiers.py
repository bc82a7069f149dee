"""Classifiers over folds, repeated splits and training shares."""
from __future__ import annotations

from pyspark.sql import functions as F

from saddle.functions.uniform import uniform_sql
from saddle.operators import metrics as m
from saddle.operators.features import classification_xy, dense_ones, standard_scale
from saddle.operators.splits import stratified_kfold
from saddle.plans import evaluation as ev
from saddle.plans.linear_sql import best_sql, f1_sql, fits_sql
from saddle.plans.registry import query, r, rs
from saddle.plans.tables import FEATURES, customer_features, table, vectors, vectors_sql
from saddle.storage import materialise

# -- one classifier ------------------------------------------------------------------------
CLASSES = 10


def _vectors(spark, sf):
    return vectors(spark, sf).select("id", "v", F.col("label").alias("y"))


def _folds_sql(source: str, k: int) -> str:
    """``folded(id, fold)`` of ``source(id, y)``."""
    return (f"folded AS (SELECT id, (row_number() OVER (PARTITION BY y ORDER BY {uniform_sql('fold', 'id')}, id) - 1) % {k} AS fold FROM {source})")


def _marks_sql(k: int, train_too: bool, sets: int = 1) -> str:
    last = f"f = {k} OR " if train_too else ""
    return (f"fm AS MATERIALIZED (SELECT ds, CAST(f AS INTEGER) AS fit, id, {last}fold <> f AS train, {last}fold = f AS test "
            f"FROM folded, range({k + train_too}) AS fs(f), range({sets}) AS sets(ds))")


_CLASSED = f"{vectors_sql()}, classed AS (SELECT id, label AS y FROM vecs), fx AS MATERIALIZED (SELECT 0 AS ds, id, [1.0::DOUBLE] || v AS v, [label] AS labels FROM vecs)"


def _classifier(name, spec):
    setting = ev.CLASSIFIERS[spec]
    sql = None
    if not isinstance(setting, ev.Forest):
        sql = (f"WITH RECURSIVE {_CLASSED}, {_folds_sql('classed', 2)}, {_marks_sql(2, False)}, {fits_sql(setting, CLASSES)}, {best_sql()} "
               f"SELECT id, y, fit AS fold, pred, {rs('p')} AS p FROM fb")

    @query(name, sql)
    def _run(spark, sf):
        folded = stratified_kfold(_vectors(spark, sf), "y", "id", 2)
        return ev.cross_val_predict(folded, setting, 2).withColumn("p", r("p"))


_classifier("clf_logistic_l2", "logistic_l2")
_classifier("clf_logistic_l1", "logistic_l1")
_classifier("clf_logistic_multinomial", "logistic_multinomial")
_classifier("clf_random_forest", "random_forest")


def _documents(spark, sf):
    """Labelled documents as vectors of simple counts, and their labels in long form."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), "quality", "toxic",
        F.array(F.log1p(F.length("text").cast("double")), F.size(F.split("text", "\n")).cast("double") / 100,
                F.length(F.regexp_replace("text", "[^0-9]", "")) / (F.length("text") + 1.0),
                F.length(F.regexp_replace("text", "[^A-Z]", "")) / (F.length("text") + 1.0)).alias("v"))
    truth = d.select("id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)))).alias("label"))
    return materialise(d.select("id", "v")), materialise(truth)


_DOCUMENTS = """fx AS MATERIALIZED (SELECT 0 AS ds, doc_id AS id, [1.0::DOUBLE, ln(1 + length(text)), len(string_split(text, chr(10))) / 100.0::DOUBLE,
    length(regexp_replace(text, '[^0-9]', '', 'g')) / (length(text) + 1.0::DOUBLE), length(regexp_replace(text, '[^A-Z]', '', 'g')) / (length(text) + 1.0::DOUBLE)] AS v,
  list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END], lambda a: a IS NOT NULL) AS labels FROM documents JOIN labels USING (doc_id)),
 fm AS MATERIALIZED (SELECT ds, 0 AS fit, id, true AS train, true AS test FROM fx)"""


@query("clf_one_vs_rest", f"WITH RECURSIVE {_DOCUMENTS}, {fits_sql(ev.CLASSIFIERS['one_vs_rest'], 2)} SELECT id, CAST(k AS INTEGER) AS label, {rs('p')} AS p FROM fp")
def _one_vs_rest(spark, sf):
    data, truth = _documents(spark, sf)
    return ev.one_vs_rest_scores(data, truth, 2, ev.CLASSIFIERS["one_vs_rest"]).withColumn("p", r("p"))


@query("cross_validate", f"WITH RECURSIVE {_CLASSED}, {_folds_sql('classed', 3)}, {_marks_sql(3, True)}, {fits_sql(ev.CLASSIFIERS['logistic_multinomial'], CLASSES)}, "
       f"{best_sql()}, {f1_sql()} SELECT 'multinomial' AS model, fit AS fold, {rs('macro')} AS macro, {rs('micro')} AS micro FROM ff")
def _cross_validate(spark, sf):
    folded = stratified_kfold(_vectors(spark, sf), "y", "id", 3)
    out = ev.cross_validate(folded, ev.CLASSIFIERS["logistic_multinomial"], 3, "multinomial")
    return out.select("model", "fold", r("macro").alias("macro"), r("micro").alias("micro"))


@query("cross_validate_multilabel")
def _cross_validate_multi(spark, sf):
    data, truth = _documents(spark, sf)
    return ev.cross_validate_multilabel(data, truth, 2, ev.CLASSIFIERS["one_vs_rest"], 2)


# -- several data sets ---------------------------------------------------------------------

def _churn(spark, sf):
    """Customers with a vector: scaled table features, vectors, and both side by side; y is churn."""
    xy, known = classification_xy(materialise(customer_features(spark, sf)), "id", "shippingCountry", "gender")
    scaled = standard_scale(xy, ["balance", "n_orders"])
    rows = scaled.select("id", "y", F.concat(F.array("balance", "n_orders"), dense_ones(known.count())).alias("f"))
    rows = materialise(rows.join(vectors(spark, sf).select("id", "v"), "id"))
    return {name: rows.select("id", v.alias("v"), "y") for name, v in
            (("features", F.col("f")), ("embedding", F.col("v")), ("both", F.concat("f", "v")))}


_CHURN_SQL = f"""{FEATURES}, {vectors_sql()},
 often AS (SELECT "shippingCountry" AS k, count(*) / (SELECT count(*) FROM features) AS share FROM features GROUP BY 1),
 kept AS (SELECT f.*, CASE WHEN share >= 0.05 THEN "shippingCountry" ELSE 'Other' END AS country FROM features f LEFT JOIN often ON k = "shippingCountry"),
 kinds AS (SELECT list(DISTINCT country ORDER BY country) AS countries, list(DISTINCT gender ORDER BY gender) AS genders FROM kept),
 feat AS (SELECT id, CAST(target_churned AS INTEGER) AS y, [(balance - avg(balance) OVER ()) / stddev_pop(balance) OVER (),
   (n_orders - avg(n_orders) OVER ()) / stddev_pop(n_orders) OVER ()] || list_transform(countries, lambda a: (a = country)::DOUBLE)
   || list_transform(genders, lambda a: (a = gender)::DOUBLE) AS f FROM kept, kinds),
 classed AS MATERIALIZED (SELECT id, y, f, v FROM feat JOIN vecs USING (id)),
 fx AS MATERIALIZED (SELECT 0 AS ds, id, [1.0::DOUBLE] || f AS v, [y] AS labels FROM classed UNION ALL SELECT 1, id, [1.0::DOUBLE] || v, [y] FROM classed
   UNION ALL SELECT 2, id, [1.0::DOUBLE] || f || v, [y] FROM classed)"""
_SETS = "(['features', 'embedding', 'both'])[ds + 1]"
_LINES = ("logistic_l2", "logistic_l1")
_ALL_SQL = (f"WITH RECURSIVE {_CHURN_SQL}, {_folds_sql('classed', 2)}, {_marks_sql(2, True, 3)}, "
            + ", ".join(f"{fits_sql(ev.CLASSIFIERS[n], 2, n)}, {best_sql(n)}, {f1_sql(n)}" for n in _LINES)
            + " " + " UNION ALL ".join(f"SELECT {_SETS} AS dataset, '{n}' AS model, fit AS fold, {rs('macro')} AS macro, {rs('micro')} AS micro FROM ff{n}" for n in _LINES))


@query("run_all_datasets_linear", _ALL_SQL)
def _linear_datasets(spark, sf):
    out = ev.run_all_datasets(_churn(spark, sf), {k: ev.CLASSIFIERS[k] for k in _LINES}, 2)
    return out.select("dataset", "model", "fold", r("macro").alias("macro"), r("micro").alias("micro"))


@query("run_all_datasets")
def _datasets(spark, sf):
    some = {k: ev.CLASSIFIERS[k] for k in (*_LINES, "random_forest")}
    return ev.run_all_datasets(_churn(spark, sf), some, 2)


@query("churn_evaluation")
def _churn_evaluation(spark, sf):
    """Three classifiers on three data sets over shared folds: F1 by fold, ranked means, and each one's paired test against the best."""
    some = {k: ev.CLASSIFIERS[k] for k in (*_LINES, "random_forest")}
    scores = materialise(ev.run_all_datasets(_churn(spark, sf), some, 3))
    folds = scores.where("fold < 3").select(F.concat_ws(":", "dataset", "model").alias("model"), F.col("fold").cast("string").alias("fold"), "macro", "micro")
    train = scores.where("fold = 3").select(F.concat_ws(":", "dataset", "model").alias("model"), F.col("macro").alias("train"))
    ranked = folds.groupBy("model").agg(F.avg("macro").alias("mean"), F.stddev_samp("macro").alias("sd"), F.avg("micro").alias("micro"))
    best = ranked.orderBy(F.col("mean").desc(), "model").limit(1).select(F.col("model").alias("best"))
    tests = m.with_p_value(m.t_test_paired(folds))
    both = tests.select(F.col("a").alias("model"), F.col("b").alias("best"), "t", "p").unionByName(
        tests.select(F.col("b").alias("model"), F.col("a").alias("best"), (-F.col("t")).alias("t"), "p"))
    against = both.join(best, "best").select("model", r("t").alias("t"), r("p").alias("p"))
    return ranked.join(train, "model").join(against, "model", "left").select(
        "model", r("mean").alias("mean"), r("sd").alias("sd"), r("micro").alias("micro"), r("train").alias("train"), "t", "p")


# -- repeated splits -----------------------------------------------------------------------
REPS, SHARES = 10, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _splits_sql(shares: list[float]) -> str:
    """``fm`` of ``classed(id, y)`` for all shares and repetitions and, last, everything; for three data sets."""
    drawn = " UNION ALL ".join(f"SELECT id, y, {rep} AS rep, {uniform_sql(f'split-{rep}', 'id')} AS u FROM classed" for rep in range(REPS))
    marks = " UNION ALL ".join(
        f"SELECT id, {s * REPS} + rep AS fit, CASE WHEN least < 2 OR least(whole, total - whole) < classes THEN overall < whole "
        f"ELSE inside < round(round(n * {share}, 9)) END AS train FROM (SELECT *, floor(round({share} * total, 9)) AS whole FROM ranked, sides)"
        for s, share in enumerate(shares))
    return f"""drawn AS ({drawn}),
 ranked AS MATERIALIZED (SELECT id, rep, row_number() OVER (PARTITION BY rep, y ORDER BY u, id) - 1 AS inside, row_number() OVER (PARTITION BY rep ORDER BY u, id) - 1 AS overall,
   count(*) OVER (PARTITION BY rep, y) AS n FROM drawn),
 sides AS (SELECT min(n) AS least, count(*) AS classes, sum(n)::DOUBLE AS total FROM (SELECT y, count(*) AS n FROM classed GROUP BY y)),
 marks AS ({marks}),
 fm AS MATERIALIZED (SELECT CAST(ds AS INTEGER) AS ds, CAST(fit AS INTEGER) AS fit, id, train, test FROM (SELECT id, fit, train, NOT train AS test FROM marks UNION ALL
   SELECT id, {len(shares) * REPS}, true, true FROM classed), range(3) AS sets(ds))"""


def _holdout_sql(shares: list[float]) -> str:
    """``held(model, share number, mean, sde, train)``."""
    last = len(shares) * REPS
    return f"""WITH RECURSIVE {_CHURN_SQL}, {_splits_sql(shares)}, {fits_sql(ev.CLASSIFIERS['logistic_multinomial'], 2)}, {best_sql()}, {f1_sql()},
 held AS (SELECT {_SETS} AS model, CAST(floor(fit / {REPS}) AS INTEGER) AS s, avg(macro) AS mean, stddev_samp(macro) / sqrt(count(*)) AS sde,
   any_value((SELECT f.macro FROM ff f WHERE f.ds = ff.ds AND f.fit = {last})) AS train FROM ff WHERE fit < {last} GROUP BY ds, s)"""


@query("repeated_holdout", f"{_holdout_sql([0.5])} SELECT model, {rs('mean')} AS mean, {rs('sde')} AS sde, {rs('train')} AS train FROM held")
def _holdout(spark, sf):
    out = ev.repeated_holdout(_churn(spark, sf), ev.CLASSIFIERS["logistic_multinomial"], REPS, 0.5)
    return out.select("model", r("mean").alias("mean"), r("sde").alias("sde"), r("train").alias("train"))


_CURVE = ", ".join(rs(f"max(mean) FILTER (s = {i})") + f' AS "{share}"' for i, share in enumerate(SHARES))


@query("train_share_curve", f"{_holdout_sql(SHARES)} SELECT model, {_CURVE} FROM held GROUP BY model")
def _curve(spark, sf):
    """Nine training shares, ten repetitions each, on three data sets: 273 fits together."""
    curve = ev.train_share_curve(_churn(spark, sf), ev.CLASSIFIERS["logistic_multinomial"], SHARES, REPS)
    wide = ev.curve_matrix(curve, SHARES)
    return wide.select("model", *[r(f"`{s}`").alias(str(s)) for s in SHARES])
