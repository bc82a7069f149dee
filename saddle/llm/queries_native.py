"""op2, op3 and op7: DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saddle.llm.registry import query, table
from saddle.llm.credentials import ACCESS, ASSIGN, BLANK, ENDPOINT, KINDS, LONG_HEX, MIXED, NAMED, REACH, secret_spans
from saddle.llm.shards import byte_shards
from saddle.llm.urlfilter import judge_urls, url_host

# -- op2 -----------------------------------------------------------------------------------


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_matches(kind: str, pattern: str) -> str:
    return (f"SELECT row, doc_id, '{kind}' AS scan, generate_subscripts(m, 1) AS nth, unnest(m) AS m, "
            f"unnest(list_slice(regexp_split_to_array(text, {_q(pattern)}), 1, len(m))) AS gap FROM ("
            f"SELECT *, regexp_extract_all(text, {_q(pattern)}) AS m FROM docs) WHERE len(m) > 0")


OP2_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(_sql_matches(k, p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", LONG_HEX),
        ("id", NAMED), ("mixed", MIXED), ("url", ENDPOINT), ("blank", BLANK)))}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, scan ORDER BY nth) AS e FROM raw),
parts AS (SELECT row, scan, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CASE scan
    WHEN 'assign' THEN CASE WHEN length(regexp_extract(m, {_q(ASSIGN)}, 2)) >= 8 THEN 'assign'
                            WHEN length(regexp_extract(m, {_q(ASSIGN)}, 2)) >= 4 THEN 'key' END
    WHEN 'access' THEN CASE WHEN length(m) >= 16 THEN 'access' END
    WHEN 'mixed' THEN CASE WHEN length(m) = 40 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')
                            AND regexp_matches(m, '[0-9]') THEN 'key' END
    WHEN 'blank' THEN NULL ELSE scan END AS kind FROM placed),
scoped AS (SELECT row, kind, s, e, (SELECT count(*) FROM parts b WHERE b.scan = 'blank' AND b.row = p.row AND b.s <= p.s) AS scope
    FROM parts p WHERE kind IS NOT NULL),
near AS (SELECT DISTINCT a.row, a.kind, a.s, a.e,
    CASE WHEN b.kind IN ('access', 'id') THEN 'i' ELSE 's' END AS has
    FROM scoped a JOIN scoped b ON a.row = b.row AND a.scope = b.scope AND (a.s <> b.s OR a.e <> b.e) AND b.kind <> 'url'
    AND least(abs(a.s - b.s), abs(a.s - b.e), abs(a.e - b.s), abs(a.e - b.e)) <= {REACH}),
kept AS (SELECT row, kind, s, e FROM scoped WHERE kind IN ('assign', 'access', 'hex')
    UNION SELECT row, kind, s, e FROM near WHERE (kind = 'id' AND has = 's') OR (kind = 'key' AND has = 'i')
    UNION SELECT row, kind, s, e FROM near WHERE kind = 'url' GROUP BY ALL HAVING count(DISTINCT has) = 2),
ranked AS (SELECT *, list_position({list(KINDS)}, kind) AS r, kind || ':' || s || ':' || e AS one FROM kept),
per AS (SELECT row, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    string_agg(one, ',' ORDER BY s, r, e) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg(one, ',' ORDER BY s, r, e) AS spans
    FROM ranked GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (row)
"""


@query("op2_secret_linking", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_spans(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["rank"] <= 3)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


# -- op3 -----------------------------------------------------------------------------------

SHARDS = 16

# DuckDB has no CRC-32: its table by the rule (reflected polynomial 0xEDB88320), then one step a byte
OP3_SQL = f"""
WITH steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps),
bytes AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
crc AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS BIGINT) AS text_crc32 FROM bytes, tab),
line AS (SELECT *, sum(size) OVER w - size AS start, sum(size) OVER () AS al FROM crc
        WINDOW w AS (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, CAST(least({SHARDS - 1}, (2 * start + size) * {SHARDS} // (2 * al)) AS INTEGER) AS shard FROM line)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""


@query("op3_byte_shards", OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return byte_shards(table(spark, sf, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# -- op7 -----------------------------------------------------------------------------------

#: First labels of listed domains.
LISTED = ("casino-win", "free-bets", "ads-track", "adult-x")
_LISTED_HOST = "(?:^|[.])((?:casino-win|free-bets|ads-track|adult-x)[.].*)$"

OP7_SQL = f"""
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM hosts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '{_LISTED_HOST}') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def listed_domains(pages: DataFrame) -> DataFrame:
    """The domains of the corpus whose first label is a listed one."""
    domain = F.regexp_extract(url_host(F.col("url")), _LISTED_HOST, 1)
    return pages.select(domain.alias("key")).where("key != ''").distinct()


@query("op7_bloom_cascade", OP7_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return judge_urls(pages, listed_domains(pages)).drop("listed")
