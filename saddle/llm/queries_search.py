"""op11, op12 and op13: ranked search, languages and hard negatives."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saddle.llm import language, lexical, negatives
from saddle.llm.registry import query, table

# -- op11 ----------------------------------------------------------------------------------

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_SQL = f"""
WITH held AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents),
docs AS (SELECT place, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM held WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counted AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
    FROM counted, totals GROUP BY term, docs),
valued AS (SELECT place, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))) AS value
    FROM counted JOIN docs USING (place) JOIN weights USING (term), totals),
scored AS (SELECT item_id, place, CAST(sum(value) AS BIGINT) AS score FROM valued JOIN wanted USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored JOIN docs USING (place) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query("op11_lexical_automaton", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("key_1", "key_2")


# -- op12 ----------------------------------------------------------------------------------

@query("op12_string_kernels")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.predict(docs, language.fit(docs)).drop("key_1", "key_2")


# -- op13 ----------------------------------------------------------------------------------

OP13_SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank,
    other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""


@query("op13_zone_map_negatives", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors are the ids divisible by 100; ids divisible by 7 carry a wrong label."""
    given = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (given + 1) % 10).otherwise(given)
    return negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
