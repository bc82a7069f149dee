"""Neighbours, vector sums, features, splits, scores and significance tests."""
from __future__ import annotations

from pyspark.sql import functions as F

from saddle.functions import geometry as g
from saddle.functions.uniform import uniform, uniform_sql
from saddle.operators import features as f
from saddle.operators import metrics as m
from saddle.operators import splits as s
from saddle.operators import vectors as v
from saddle.operators.neighbours import nearest
from saddle.plans.registry import query, r, rs, vec_rows
from saddle.plans.tables import (
    CUSTOMER_LABELS, FEATURES, VIEWS, WIDTH, customer_features, customer_labels, start_sql, start_vectors, table, vectors,
    vectors_sql, views,
)
from saddle.skew import lookup_join
from saddle.storage import materialise

# -- neighbours ----------------------------------------------------------------------------
# asked for every twentieth id, a set that grows with the table; each search has two names

def _nearest_sql(source, cost, score):
    return (f"WITH {source}, scored AS (SELECT q.id AS query, e.id, {cost} AS cost FROM space q JOIN space e ON e.id <> q.id "
            f"WHERE q.id % 20 = 0) SELECT query, id, {rs(score)} AS score, CAST(rank AS INTEGER) AS rank "
            "FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cost, id) AS rank FROM scored) WHERE rank <= 10")


def _neighbours(space, metric):
    return nearest(space, space.where("id % 20 = 0").select("id"), 10, metric).withColumn("score", r("score"))


_SIMILAR = vectors_sql(name="space"), "-list_cosine_similarity(q.v, e.v)", "-cost"


@query("most_similar_every_20th", _nearest_sql(*_SIMILAR))
@query("most_similar", _nearest_sql(*_SIMILAR))
def _similar(spark, sf):
    return _neighbours(vectors(spark, sf), "cosine")


_GAP = "list_sum(list_transform(list_zip(q.v, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_POINCARE = (vectors_sql(0.5, "space"), f"acosh(1 + 2 * {_GAP} / ((1 - list_dot_product(q.v, q.v)) * (1 - list_dot_product(e.v, e.v))))", "cost")


@query("knn_poincare_every_20th", _nearest_sql(*_POINCARE))
@query("knn_poincare", _nearest_sql(*_POINCARE))
def _knn_poincare(spark, sf):
    return _neighbours(vectors(spark, sf, 0.5), "poincare")


_HYPER = (vectors_sql(0.5, "ball") + ", space AS (SELECT id, list_concat([(1 + list_dot_product(v, v)) / (1 - list_dot_product(v, v))], "
          "list_transform(v, lambda a: 2 * a / (1 - list_dot_product(v, v)))) AS v FROM ball)")
_LORENTZ = _HYPER, "acosh(greatest(2 * q.v[1] * e.v[1] - list_dot_product(q.v, e.v), 1.0))", "cost"


@query("knn_lorentz_every_20th", _nearest_sql(*_LORENTZ))
@query("knn_lorentz", _nearest_sql(*_LORENTZ))
def _knn_lorentz(spark, sf):
    return _neighbours(vectors(spark, sf, 0.5).withColumn("v", g.poincare_to_hyperboloid("v")), "lorentz")


@query("prod2cust_sum", f"WITH {VIEWS}, {start_sql(2, 0.5)} SELECT customer_id, {rs('sum(w_in[1])')} AS v1, {rs('sum(w_in[2])')} AS v2 "
       "FROM views JOIN state ON id = product_id GROUP BY customer_id")
def _prod2cust(spark, sf):
    emb = start_vectors(spark, sf, 2, 0.5).select("id", F.col("w_in").alias("v"))
    out = v.prod2cust_sum(views(spark, sf), emb, 2)
    return out.select("customer_id", r(F.col("v")[0]).alias("v1"), r(F.col("v")[1]).alias("v2"))


@query("first_label", f"WITH {CUSTOMER_LABELS} SELECT id, min(label) AS label FROM labelled GROUP BY id")
def _first_label(spark, sf):
    return v.first_label(customer_labels(spark, sf))



@query("one_hot", "WITH top AS (SELECT max(p_size) AS hi FROM part), outv AS (SELECT p_partkey AS id, "
       "list_transform(range(1, (SELECT hi FROM top) + 1), lambda i: CASE WHEN i = p_size THEN 1 ELSE 0 END) AS w FROM part) "
       "SELECT id, CAST(pos - 1 AS INTEGER) AS pos, CAST(val AS INTEGER) AS value FROM (SELECT id, unnest(w) AS val, generate_subscripts(w, 1) AS pos FROM outv)")
def _one_hot(spark, sf):
    hot = v.one_hot(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size"), "p_size")
    return hot.select("id", F.posexplode("hot").alias("pos", "value"))


@query("not_hot", "SELECT vec_id AS id, label AS cls FROM embeddings")
def _not_hot(spark, sf):
    hot = v.one_hot(vectors(spark, sf).select("id", "label"), "label")
    return v.not_hot(hot).select("id", "cls")


# -- features ------------------------------------------------------------------------------
PCT = 0.045
_RARE = (f"{FEATURES}, freq AS (SELECT \"shippingCountry\" AS k, count(*) / (SELECT count(*) FROM features) AS share FROM features GROUP BY 1), "
         f"rare AS (SELECT f.* REPLACE (CASE WHEN share >= {PCT} THEN \"shippingCountry\" ELSE 'Other' END AS \"shippingCountry\") "
         "FROM features f LEFT JOIN freq ON k = \"shippingCountry\")")


@query("rare_to_other", f"WITH {_RARE} SELECT id, \"shippingCountry\" FROM rare")
def _rare(spark, sf):
    return f.rare_to_other(customer_features(spark, sf).select("id", "shippingCountry"), "shippingCountry", PCT)


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_FLAGS = ", ".join(f"CAST(gender = '{x}' AS INTEGER) AS \"gender_{x}\"" for x in _SEG)


@query("dummies", f"WITH {FEATURES} SELECT id, balance, {_FLAGS} FROM features")
def _dummies(spark, sf):
    return f.dummies(customer_features(spark, sf).select("id", "balance", "gender"), {"gender": _SEG})


def _flat(rows, known):
    """The row's values by the dictionary, as columns again."""
    named = rows.select("id", F.explode("ones").alias("pos")).join(known, "pos").groupBy("id").agg(
        F.max(F.when(F.col("column") == "shippingCountry", F.col("value"))).alias("country"), F.max(F.when(F.col("column") == "gender", F.col("value"))).alias("segment"))
    return lookup_join(rows, named, "id", "left")


@query("dummy_positions", f"""WITH {FEATURES}, named AS (SELECT id, 'gender' AS col, gender AS val FROM features UNION ALL SELECT id, 'shippingCountry', "shippingCountry" FROM features),
 known AS (SELECT col, val, row_number() OVER (ORDER BY col, val) - 1 AS pos FROM (SELECT DISTINCT col, val FROM named WHERE val IS NOT NULL))
 SELECT id, pos, col || '_' || val AS name FROM named JOIN known USING (col, val)""")
def _dummy_positions(spark, sf):
    """All values of two columns as positions in a dictionary, a row per one."""
    rows, known = f.dummy_positions(materialise(customer_features(spark, sf)), "id", ["shippingCountry", "gender"])
    ones = rows.select("id", F.explode("ones").alias("pos")).join(known, "pos")
    return ones.select("id", "pos", F.concat_ws("_", "column", "value").alias("name"))


@query("classification_xy", f"WITH {_RARE} SELECT id, balance, n_orders, \"shippingCountry\" AS country, gender AS segment, "
       "CAST(target_churned AS INTEGER) AS y FROM rare")
def _classification(spark, sf):
    xy = f.classification_xy(materialise(customer_features(spark, sf)), "id", "shippingCountry", "gender", PCT)
    return _flat(*xy).select("id", "balance", "n_orders", "country", "segment", "y")


@query("regression_xy", f"WITH {_RARE} SELECT id, balance, n_orders, \"shippingCountry\" AS country, gender AS segment, "
       f"{rs('rank() OVER (ORDER BY target_net_value) / (SELECT count(*) FROM features)')} AS y FROM rare")
def _regression(spark, sf):
    xy = f.regression_xy(materialise(customer_features(spark, sf)), "id", "shippingCountry", "gender", PCT)
    return _flat(*xy).select("id", "balance", "n_orders", "country", "segment", r("y").alias("y"))


@query("standard_scale", f"WITH {FEATURES} SELECT id, {rs('(balance - avg(balance) OVER ()) / stddev_pop(balance) OVER ()')} AS balance, "
       f"{rs('(n_orders - avg(n_orders) OVER ()) / stddev_pop(n_orders) OVER ()')} AS n_orders FROM features")
def _scale(spark, sf):
    out = f.standard_scale(customer_features(spark, sf).select("id", "balance", "n_orders"), ["balance", "n_orders"])
    return out.select("id", r("balance").alias("balance"), r("n_orders").alias("n_orders"))


@query("column_l2_normalize", f"WITH {FEATURES} SELECT id, {rs('balance / sqrt(sum(balance * balance) OVER ())')} AS balance, "
       f"{rs('n_orders / sqrt(sum(n_orders * n_orders) OVER ())')} AS n_orders FROM features")
def _l2(spark, sf):
    out = f.column_l2_normalize(customer_features(spark, sf).select("id", "balance", "n_orders"), ["balance", "n_orders"])
    return out.select("id", r("balance").alias("balance"), r("n_orders").alias("n_orders"))


@query("vector_l2_normalize", f"WITH {vectors_sql()}, cells AS (SELECT id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS val FROM vecs) "
       f"SELECT id, CAST(pos AS INTEGER) AS pos, {rs('val / sqrt(sum(val * val) OVER (PARTITION BY pos))')} AS value FROM cells")
def _vector_l2(spark, sf):
    return vec_rows(f.vector_l2_normalize(vectors(spark, sf).select("id", "v"), "v", WIDTH), ["id"], "v")


# between-class over within-class variance of each coordinate
_ANOVA = f"""WITH {vectors_sql()}, cells AS (SELECT id, label, generate_subscripts(v, 1) AS c, unnest(v) AS val FROM vecs),
 per AS (SELECT c, label, count(*) AS n, avg(val) AS mu, var_pop(val) * count(*) AS inside FROM cells GROUP BY 1, 2),
 whole AS (SELECT c, avg(val) AS mu FROM cells GROUP BY 1),
 ratio AS (SELECT per.c, sum(n * (per.mu - whole.mu) ** 2) / (count(*) - 1) / (sum(inside) / (sum(n) - count(*))) AS f
   FROM per JOIN whole USING (c) GROUP BY 1),
 kept AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS pos FROM (SELECT c FROM ratio ORDER BY f DESC, c LIMIT 16))
 SELECT id, label, CAST(pos AS INTEGER) AS pos, {rs('val')} AS value FROM cells JOIN kept USING (c)"""


@query("select_features", _ANOVA)
def _select(spark, sf):
    return vec_rows(f.select_features(vectors(spark, sf), "v", "label", WIDTH, 16), ["id", "label"], "v")


@query("balance_classes", f"SELECT id, cat FROM (SELECT c_custkey AS id, c_nationkey AS cat, row_number() OVER (PARTITION BY c_nationkey "
       f"ORDER BY {uniform_sql(10, 'c_custkey')}, c_custkey) AS k FROM customer) WHERE NOT (cat = 2 AND k > 23) AND NOT (cat = 9 AND k > 10)")
def _balance(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cat"))
    return f.balance_classes(rows, "cat", "id", {2: 23, 9: 10})


@query("stratified_sample_n", f"SELECT o_orderkey, c_custkey AS id, c_mktsegment AS cat FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment "
       f"ORDER BY {uniform_sql('sample', 'c_custkey')}, c_custkey) AS k FROM customer) JOIN orders ON o_custkey = c_custkey WHERE k <= 10")
def _stratified_n(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cat"))
    chosen = f.stratified_sample_n(rows, "cat", "id", 10)
    data = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return lookup_join(data, chosen, "id").select("o_orderkey", "id", "cat")


# -- splits --------------------------------------------------------------------------------

def _churn(spark, sf):
    return customer_features(spark, sf).select("id", F.col("target_churned").cast("int").alias("y"))


_CHURN = f"{FEATURES}, churn AS (SELECT id, CAST(target_churned AS INTEGER) AS y FROM features)"


def _ranked(seed, partition=""):
    return f"row_number() OVER ({partition} ORDER BY {uniform_sql(seed, 'id')}, id) - 1"


@query("stratified_kfold", f"WITH {_CHURN} SELECT id, y, CAST(({_ranked('fold', 'PARTITION BY y')}) % 5 AS INTEGER) AS fold FROM churn")
def _stratified(spark, sf):
    return s.stratified_kfold(_churn(spark, sf), "y", "id", 5)


@query("kfold", f"WITH {_CHURN} SELECT id, y, CAST(({_ranked('fold')}) % 5 AS INTEGER) AS fold FROM churn")
def _kfold(spark, sf):
    return s.kfold(_churn(spark, sf), "id", 5)


@query("train_test_split_stratified", f"WITH {_CHURN} SELECT id, y, {_ranked('split', 'PARTITION BY y')} < round(0.7 * count(*) OVER (PARTITION BY y)) AS is_train FROM churn")
def _split(spark, sf):
    return s.train_test_split_stratified(_churn(spark, sf), "y", "id", 0.7)


@query("bernoulli_split", f"WITH {_CHURN} SELECT id, y, {uniform_sql('mask', 'id')} < 0.8 AS is_train FROM churn")
def _bernoulli(spark, sf):
    return s.bernoulli_split(_churn(spark, sf), "id")


# -- scores --------------------------------------------------------------------------------

def _rules(spark, sf):
    """Four fixed rules that guess churn, with folds: ``(fold, model, y, pred)``."""
    rows = customer_features(spark, sf).select("id", "gender", "balance", "n_orders", F.col("target_churned").cast("int").alias("y"))
    folded = s.kfold(rows, "id", 5)
    guess = {"balance": F.col("balance") < 0, "segment": F.col("gender").isin("BUILDING", "MACHINERY"),
             "orders": F.col("n_orders") < 9, "coin": uniform("coin", "id") < 0.5}
    each = F.array(*[F.struct(F.lit(k).alias("model"), e.cast("int").alias("pred")) for k, e in guess.items()])
    return folded.select("id", "fold", "y", F.explode(each).alias("g")).select("id", "fold", "y", "g.model", "g.pred")


_RULES = f"""{FEATURES}, folded AS (SELECT *, CAST(({_ranked('fold')}) % 5 AS INTEGER) AS fold FROM features),
 wide AS (SELECT id, fold, CAST(target_churned AS INTEGER) AS y, CAST(balance < 0 AS INTEGER) AS m1,
   CAST(gender IN ('BUILDING', 'MACHINERY') AS INTEGER) AS m2, CAST(n_orders < 9 AS INTEGER) AS m3,
   CAST({uniform_sql('coin', 'id')} < 0.5 AS INTEGER) AS m4 FROM folded),
 rules AS (SELECT id, fold, y, 'balance' AS model, m1 AS pred FROM wide UNION ALL SELECT id, fold, y, 'segment', m2 FROM wide
   UNION ALL SELECT id, fold, y, 'orders', m3 FROM wide UNION ALL SELECT id, fold, y, 'coin', m4 FROM wide)"""
_SCORES = f"""{_RULES}, tally AS (SELECT model, fold, c AS label, count(CASE WHEN y = c AND pred = c THEN 1 END) AS tp,
   count(CASE WHEN y <> c AND pred = c THEN 1 END) AS fp, count(CASE WHEN y = c AND pred <> c THEN 1 END) AS fn
   FROM rules, range(2) t(c) GROUP BY ALL),
 scores AS (SELECT model, CAST(fold AS VARCHAR) AS fold, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS macro,
   2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro FROM tally GROUP BY 1, 2)"""


def _scores(spark, sf):
    counts = m.confusion_single(_rules(spark, sf), ["model", "fold"])
    return m.f1_macro_micro(counts, ["model", "fold"]).withColumn("fold", F.col("fold").cast("string"))


@query("argmax_predict", f"WITH {vectors_sql()} SELECT id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS pred FROM vecs")
def _argmax(spark, sf):
    return m.argmax_predict(vectors(spark, sf), "v").select("id", "pred")


_TRUTH = ("truth AS (SELECT doc_id AS id, 0 AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1 "
          "UNION ALL SELECT doc_id, 2 FROM labels JOIN documents USING (doc_id) WHERE lang <> 'en')")


def _doc_scores(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    truth = F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1), F.when(F.col("lang") != "en", 2)))
    truths = d.select(F.col("doc_id").alias("id"), F.explode(truth).alias("label"))
    p = F.array(F.col("n_chars") / (F.col("n_chars") + 1000.0), uniform("toxic", "doc_id"), uniform("lang", "doc_id"))
    scores = d.select(F.col("doc_id").alias("id"), F.posexplode(p).alias("label", "p"))
    return truths, scores


_PROBS = ("probs AS (SELECT doc_id AS id, 0 AS label, n_chars / (n_chars + 1000.0) AS p FROM labels JOIN documents USING (doc_id) "
          f"UNION ALL SELECT doc_id, 1, {uniform_sql('toxic', 'doc_id')} FROM labels UNION ALL SELECT doc_id, 2, {uniform_sql('lang', 'doc_id')} FROM labels)")
_TOPN = f"{_TRUTH}, {_PROBS}, need AS (SELECT id, count(*) AS k FROM truth GROUP BY id), best AS (SELECT id, label FROM (SELECT id, label, "\
        "row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS rn FROM probs) JOIN need USING (id) WHERE rn <= k)"


@query("topn_multilabel", f"WITH {_TOPN} SELECT id, label FROM best")
def _topn(spark, sf):
    truth, scores = _doc_scores(spark, sf)
    return m.topn_multilabel(scores, truth)


_CONF = f"{_TOPN}, cells AS (SELECT coalesce(t.label, b.label) AS label, t.id AS t, b.id AS b FROM truth t FULL JOIN best b ON t.id = b.id AND t.label = b.label), "\
        "conf AS (SELECT label, count(CASE WHEN t IS NOT NULL AND b IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN t IS NULL THEN 1 END) AS fp, "\
        "count(CASE WHEN b IS NULL THEN 1 END) AS fn FROM cells GROUP BY 1)"


@query("confusion_counts", f"WITH {_CONF} SELECT label, tp, fp, fn FROM conf")
def _confusion(spark, sf):
    truth, scores = _doc_scores(spark, sf)
    return m.confusion_counts(truth, m.topn_multilabel(scores, truth))


@query("class_scores", f"WITH {_CONF} SELECT label, tp, fp, fn, {rs('CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END')} AS precision, "
       f"{rs('CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END')} AS recall, "
       f"{rs('CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END')} AS f1 FROM conf")
def _class_scores(spark, sf):
    truth, scores = _doc_scores(spark, sf)
    out = m.class_scores(m.confusion_counts(truth, m.topn_multilabel(scores, truth)))
    return out.select("label", "tp", "fp", "fn", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@query("f1_macro_micro", f"WITH {_SCORES} SELECT model, fold, {rs('macro')} AS macro, {rs('micro')} AS micro FROM scores")
def _f1(spark, sf):
    return _scores(spark, sf).select("model", "fold", r("macro").alias("macro"), r("micro").alias("micro"))


@query("roc_auc", "WITH x AS (SELECT quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id)), "
       "ranked AS (SELECT y, avg(rn) OVER (PARTITION BY score) AS rk FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM x)) "
       f"SELECT {rs('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))')} AS auc FROM ranked")
def _auc(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return m.roc_auc(rows, "quality", "n_chars").select(r("auc").alias("auc"))


# -- results -------------------------------------------------------------------------------

@query("merge_results", f"WITH {_SCORES}, everything AS (SELECT model, c AS label, count(CASE WHEN y = c AND pred = c THEN 1 END) AS tp, "
       "count(CASE WHEN y <> c AND pred = c THEN 1 END) AS fp, count(CASE WHEN y = c AND pred <> c THEN 1 END) AS fn FROM rules, range(2) t(c) GROUP BY ALL) "
       f"SELECT model, fold, {rs('macro')} AS macro, {rs('micro')} AS micro FROM scores UNION ALL "
       f"SELECT model, 'train', {rs('avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END)')}, "
       f"{rs('2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} FROM everything GROUP BY model")
def _merge(spark, sf):
    folds = _scores(spark, sf).withColumn("fold", F.col("fold").cast("int"))
    train = m.f1_macro_micro(m.confusion_single(_rules(spark, sf), ["model"]), ["model"]).withColumn("fold", F.lit(5))
    merged = m.merge_results([folds, train.select(*folds.columns)], 5)
    return merged.select("model", "fold", r("macro").alias("macro"), r("micro").alias("micro"))


@query("results_ranked", f"WITH {_SCORES} SELECT model, {rs('avg(macro)')} AS mean FROM scores GROUP BY model ORDER BY 2 DESC, 1")
def _ranked_results(spark, sf):
    return m.results_ranked(_scores(spark, sf)).withColumn("mean", r("mean"))


@query("t_test_paired_grid", f"WITH {_SCORES}, gap AS (SELECT a.model AS a, b.model AS b, a.macro - b.macro AS g FROM scores a JOIN scores b "
       f"ON a.fold = b.fold AND a.model < b.model) SELECT a, b, {rs('avg(g) / (stddev_samp(g) / sqrt(count(*)))')} AS t, "
       "CAST(count(*) - 1 AS DOUBLE) AS df FROM gap GROUP BY a, b")
def _paired(spark, sf):
    return m.t_test_paired(_scores(spark, sf)).withColumn("t", r("t"))


_WELCH = f"{_SCORES}, per AS (SELECT model, avg(macro) AS mu, var_samp(macro) / count(*) AS e, count(*) AS n FROM scores GROUP BY model)"


@query("t_test_welch_grid", f"WITH {_WELCH} SELECT a.model AS a, b.model AS b, {rs('(a.mu - b.mu) / sqrt(a.e + b.e)')} AS t, "
       f"{rs('pow(a.e + b.e, 2) / (a.e * a.e / (a.n - 1) + b.e * b.e / (b.n - 1))')} AS df FROM per a JOIN per b ON a.model < b.model")
def _welch(spark, sf):
    return m.t_test_welch(_scores(spark, sf)).select("a", "b", r("t").alias("t"), r("df").alias("df"))


# for whole degrees of freedom the tail is a finite sum over powers of the cosine of atan(t / sqrt(df))
_PAIRED = (f"{_SCORES}, gap AS (SELECT a.model AS a, b.model AS b, a.macro - b.macro AS g FROM scores a JOIN scores b "
           "ON a.fold = b.fold AND a.model < b.model), tt AS (SELECT a, b, avg(g) / (stddev_samp(g) / sqrt(count(*))) AS t, "
           "CAST(count(*) - 1 AS DOUBLE) AS df FROM gap GROUP BY a, b), "
           "tc AS (SELECT *, atan(abs(t) / sqrt(df)) AS th, cos(atan(abs(t) / sqrt(df))) AS co, sin(atan(abs(t) / sqrt(df))) AS si, CAST(df AS INTEGER) AS k FROM tt)")
_EVEN = "list_sum(list_transform(range(k // 2), lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1)) / pow(4, j) * pow(co, 2 * j)))"
_ODD = "coalesce(list_sum(list_transform(range((k - 1) // 2), lambda j: exp(2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(4, j) * pow(co, 2 * j + 1))), 0)"


@query("t_test_p_values", f"WITH {_PAIRED} SELECT a, b, {rs('t')} AS t, df, "
       f"{rs(f'CASE WHEN k % 2 = 0 THEN 1 - si * {_EVEN} ELSE 1 - 2 / pi() * (th + si * {_ODD}) END')} AS p FROM tc")
def _p_values(spark, sf):
    return m.with_p_value(m.t_test_paired(_scores(spark, sf))).select("a", "b", r("t").alias("t"), "df", r("p").alias("p"))


@query("results_summary", f"WITH {_SCORES} SELECT model, {rs('avg(macro)')} AS mean_macro, {rs('avg(micro)')} AS mean_micro FROM scores GROUP BY model")
def _summary(spark, sf):
    return m.results_summary(_scores(spark, sf)).select("model", r("mean_macro").alias("mean_macro"), r("mean_micro").alias("mean_micro"))


@query("mean_f1_all", f"WITH {_SCORES} SELECT model, {rs('avg(macro)')} AS mean_macro FROM scores GROUP BY model")
def _mean_all(spark, sf):
    return m.mean_f1_all(_scores(spark, sf)).withColumn("mean_macro", r("mean_macro"))
