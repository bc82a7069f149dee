"""Credential spans in texts, and weak candidates that only count beside their other parts.

Strong spans (kinds assign, access, hex) stand alone. Weak ones (an account name, a short or
unlabelled secret, an endpoint) are common in harmless text; they are reported only when the parts
that would complete a credential lie near them in the same scope. A scope is a block of text
between blank lines, and near means that an end of one lies at most ``REACH`` code points from an
end of the other:

* ``id``  (an account or client name) beside a secret (assign, hex or key);
* ``key`` (a 40-character mixed token, or an assigned value of 4 to 7 characters) beside an identifier (access or id);
* ``url`` (an endpoint) beside both an identifier and a secret.

Parts are cut into buckets of ``REACH`` code points and joined on (row, scope, bucket), the other
side standing in its neighbouring buckets too; semi joins keep one row per part however many
partners it has. Everything is DataFrame functions: ``split`` gives the lengths between matches and
running sums of these the positions, so the text is scanned once and never shuffled.

Null texts count as empty. Repeated rows and equal ids are scanned each on its own (a row number
tells them apart). Other columns are not read, so no name can clash. An empty table gives an empty
result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saddle.llm.rows import attach, key_columns
from saddle.storage import materialise

#: Kinds in the order that breaks ties at one start.
KINDS = ("assign", "access", "hex", "id", "key", "url")
REACH = 400

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# the same spans of 32 and more as the runs of HEX have, without a hit at every letter
LONG_HEX = r"[0-9a-f]{32,}"
NAMED = r"""(?i:client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})"""
MIXED = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"""(?:https?|s3|jdbc|postgresql|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""
BLANK = r"\n[\x20\x09\x0D]*\n"
PATTERNS = (("assign", ASSIGN), ("access", ACCESS), ("hex", LONG_HEX), ("id", NAMED), ("mixed", MIXED), ("url", ENDPOINT))


def _kept_as(kind: str, found: Column) -> Column:
    """The kind under which a match counts, or null where it fails."""
    if kind == "assign":
        value = F.length(F.regexp_extract(found, ASSIGN, 2))
        return F.when(value >= 8, F.lit("assign")).when(value >= 4, F.lit("key"))
    if kind == "access":
        return F.when(F.length(found) >= 16, F.lit("access"))
    if kind == "mixed":
        mixed = found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9]")
        return F.when((F.length(found) == 40) & mixed, F.lit("key"))
    return F.lit(kind)


def _hits(text: Column, kind: str, pattern: str, found: Column) -> Column:
    """Matches as ``(scan, nth, gap, len, kind)``: the code points before each match and in it."""
    pieces = F.split(text, pattern, -1)
    each = F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("scan"), i.alias("nth"), F.length(F.get(pieces, i)).alias("gap"),
        F.length(m).alias("len"), _kept_as(kind, m).alias("kind")))
    return F.when(F.size(found) > 0, each)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One written row per document: ``row, key_1, key_2, doc_id, hits``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *key_columns(id_col, text_col), F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS])
    weak = (F.size("m_id") > 0) | (F.size("m_mixed") > 0) | (F.size("m_url") > 0) | (F.size("m_assign") > 0)
    found = found.withColumn("m_blank", F.when(weak, F.regexp_extract_all("text", F.lit(BLANK), F.lit(0))))
    lists = [_hits(F.col("text"), k, p, F.col(f"m_{k}")) for k, p in (*PATTERNS, ("blank", BLANK))]
    none = F.array().cast("array<struct<scan:string,nth:int,gap:int,len:int,kind:string>>")
    hits = F.concat(*[F.coalesce(x.cast("array<struct<scan:string,nth:int,gap:int,len:int,kind:string>>"), none) for x in lists])
    return materialise(found.select("row", "key_1", "key_2", "doc_id", hits.alias("hits")))


def _parts(scan: DataFrame) -> DataFrame:
    """Every match with its positions, its kind (null: failed) and its scope's number."""
    each = scan.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    upto = Window.partitionBy("row", "scan").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    placed = each.select("row", "scan", "kind", (end - F.col("len")).alias("start"), end.alias("end"))
    earlier = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    scope = F.count(F.when(F.col("scan") == "blank", 1)).over(earlier)
    kind = F.when(F.col("scan") != "blank", F.col("kind"))
    return placed.select("row", kind.alias("kind"), "start", "end", scope.alias("scope"))


def _beside(parts: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of ``parts`` with an end at most ``REACH`` from an end of one of ``others`` in the same scope."""
    bucket = F.floor(F.col("at") / REACH)
    mine = parts.withColumn("at", F.explode(F.array("start", "end"))).withColumn("bucket", bucket)
    theirs = others.select(
        F.col("row").alias("o_row"), F.col("scope").alias("o_scope"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.array("start", "end")).alias("at"),
    ).withColumn("o_bucket", F.explode(F.sequence(bucket - 1, bucket + 1))).withColumnRenamed("at", "o_at")
    near = ((F.col("row") == F.col("o_row")) & (F.col("scope") == F.col("o_scope")) & (F.col("bucket") == F.col("o_bucket"))
            & (F.abs(F.col("at") - F.col("o_at")) <= REACH)
            & ((F.col("start") != F.col("o_start")) | (F.col("end") != F.col("o_end"))))
    return mine.join(theirs, near, "left_semi").drop("at", "bucket")


def _linked(parts: DataFrame) -> DataFrame:
    """The weak parts whose complements co-occur; a part may come twice."""
    ids = parts.where(F.col("kind").isin("access", "id"))
    secrets = parts.where(F.col("kind").isin("assign", "hex", "key"))
    return (_beside(parts.where("kind = 'id'"), secrets)
            .unionByName(_beside(parts.where("kind = 'key'"), ids))
            .unionByName(_beside(_beside(parts.where("kind = 'url'"), ids), secrets)))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``key_1, key_2, doc_id, spans``, spans sorted ``(start, rank, kind, end)``.

    Positions are code points, ends exclusive; ``rank`` is the kind's place in ``KINDS``.
    """
    scan = _scan(docs, id_col, text_col)
    parts = materialise(_parts(scan))
    strong = parts.where(F.col("kind").isin("assign", "access", "hex"))
    spans = strong.unionByName(_linked(parts))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    found = scan.select("row", "key_1", "key_2", "doc_id").join(spans, "row", "left")
    return found.select("key_1", "key_2", "doc_id", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; overlapping spans share one mark.

    Null texts stay null.
    """
    name = "secret_spans"
    while name in docs.columns:
        name += "_"
    found = secret_spans(docs, id_col, text_col).where(F.size("spans") > 0)
    found = found.groupBy("key_1", "key_2").agg(F.first("spans").alias(name))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("pos"))

    def cut(done: Column, span: Column) -> Column:
        gap = F.substring(F.col(text_col), (done["pos"] + 1).cast("int"), F.greatest(span["start"] - done["pos"], F.lit(0)).cast("int"))
        fresh = F.when((span["start"] >= done["pos"]) | (done["pos"] == 0), F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"])
        return F.struct(fresh.alias("out"), F.greatest(done["pos"], span["end"]).alias("pos"))

    cleaned = F.aggregate(name, begin, cut, lambda done: F.concat(
        done["out"], F.substring(F.col(text_col), (done["pos"] + 1).cast("int"), F.lit(2**31 - 1))))
    new = F.when(F.col(name).isNotNull(), cleaned).otherwise(F.col(text_col))
    return attach(docs, found, id_col, text_col).select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])
