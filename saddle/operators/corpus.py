"""Vocabulary, skip-gram pairs and co-occurrence counts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saddle.functions.uniform import uniform
from saddle.ordering import followers, global_index, running_total
from saddle.skew import dealt, grouped_rank, lookup_join
from saddle.storage import materialise

CHUNK = 4096
# fixed values: the characters between words
BLANKS = " \t\n\x0b\f\r"


def document_tokens(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole texts as lower-case words: ``(sentence_id, pos, token)``."""
    # trimmed first, so only a blank text yields an empty word
    words = F.split(F.btrim(F.lower(F.col(text)), F.lit(BLANKS)), f"[{BLANKS}]+")
    exploded = documents.select(F.col(id_col).alias("sentence_id"), F.posexplode(words).alias("pos", "token"))
    return exploded.where("token <> ''").withColumn("pos", F.col("pos").cast("bigint"))


# -- vocabulary ----------------------------------------------------------------------------

def token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def vocabulary(tokens: DataFrame, min_count: int = 0) -> DataFrame:
    """``(token, freq, idx)`` by falling frequency, ties by token, from 0."""
    kept = token_counts(tokens).where(F.col("freq") >= min_count)
    return global_index(kept, [F.col("freq").desc(), F.col("token")], "idx").select("token", "freq", "idx")


def vocabulary_unk(tokens: DataFrame, min_count: int = 5, unknown: str = "UNK") -> DataFrame:
    """As ``vocabulary`` from index 1; index 0 stands for all dropped tokens."""
    counts = materialise(token_counts(tokens))
    known = global_index(counts.where(F.col("freq") >= min_count),
                         [F.col("freq").desc(), F.col("token")], "idx", 1)
    dropped = counts.agg(
        F.coalesce(F.sum(F.when(F.col("freq") < min_count, F.col("freq"))), F.lit(0)).alias("freq")
    ).select(F.lit(unknown).alias("token"), "freq", F.lit(0).cast("bigint").alias("idx"))
    return dropped.unionByName(known.select("token", "freq", "idx"))


def encode_corpus(tokens: DataFrame, vocab: DataFrame, unknown: int | None = None) -> DataFrame:
    """Tokens become indices; unknown ones take ``unknown`` or leave."""
    how = "inner" if unknown is None else "left"
    coded = lookup_join(tokens, vocab.select("token", "idx"), "token", how)
    idx = F.col("idx") if unknown is None else F.coalesce("idx", F.lit(unknown).cast("bigint"))
    return coded.select("sentence_id", "pos", idx.alias("idx"))


def unigram_counts(views: DataFrame, id_col: str, index: DataFrame) -> DataFrame:
    """Rows per id beside the id's index: both sides hold one row per id."""
    counts = views.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return index.join(counts, "id").select("idx", "n")


# -- pairs ---------------------------------------------------------------------------------

def _windowed(tokens: DataFrame, window: int, backward: bool = False, reach: Column | None = None, rows: int = 0) -> DataFrame:
    """Each token beside its next ``window`` tokens (and the previous ones on request), at most ``reach`` places away.

    ``reach`` is computed once a token, before its pairs are made. Sentences are cut into chunks that overlap by the window, so no chunk outgrows a task. Where
    the rows are already hash partitioned by sentence this adds no shuffle. Given their number ``rows``, many tokens fill more tasks.
    """
    if reach is not None:
        tokens = tokens.withColumn("_reach", reach.cast("int"))
    home = F.expr(f"pos div {CHUNK}")
    chunks = F.when((F.col("pos") % CHUNK < window) & (home > 0), F.array(home, home - 1))
    if backward:
        chunks = F.when((F.col("pos") % CHUNK < window) & (home > 0), F.array(home, home - 1)).when(
            F.col("pos") % CHUNK >= CHUNK - window, F.array(home, home + 1))
    cut = tokens.withColumn("_home", home).withColumn("_chunk", F.explode(chunks.otherwise(F.array(home))))
    cut = dealt(cut, rows, "sentence_id", "_chunk")
    order = Window.partitionBy("sentence_id", "_chunk").orderBy("pos")
    within = lambda k, y: F.struct(F.lit(k).alias("k"), (y if reach is None else F.when(F.col("_reach") >= abs(k), y)).alias("y"))
    near = [within(k, F.lead("token", k).over(order)) for k in range(1, window + 1)]
    if backward:
        near += [within(-k, F.lag("token", k).over(order)) for k in range(1, window + 1)]
    return (
        cut.withColumn("_near", F.array(*near))
        .where(F.col("_chunk") == F.col("_home"))
        .select("sentence_id", "pos", F.col("token").alias("x"), F.explode("_near").alias("n"))
        .where("n.y is not null")
        .select("sentence_id", "pos", "x", F.col("n.k").alias("k"), F.col("n.y").alias("y"))
    )


def _mirror(pairs: DataFrame, *extra: str) -> DataFrame:
    ways = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return pairs.select(F.explode(ways).alias("p"), *extra).select("p.x", "p.y", *extra)


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair as its first and as its second token sees it."""
    back = F.struct((F.col("pos") + F.col("k")).alias("pos"), (-F.col("k")).alias("k"), F.col("y").alias("x"), F.col("x").alias("y"))
    return pairs.select("sentence_id", F.explode(F.array(F.struct("pos", "k", "x", "y"), back)).alias("p")).select("sentence_id", "p.*")


def skipgram_pairs(tokens: DataFrame, window: int, rows: int = 0) -> DataFrame:
    """``(sentence_id, pos, k, x, y)``: x at ``pos`` and y ``k`` places on or back, within ``window``, where the tokens differ."""
    return _both_ways(_windowed(tokens, window, rows=rows).where("x <> y"))


def skipgram_pairs_positional(tokens: DataFrame, window: int) -> DataFrame:
    """As above, but only the same position is excluded; equal tokens may pair."""
    return _both_ways(_windowed(tokens, window))


def skipgram_pairs_dynamic(stream: DataFrame, window: int, seed: str = "window") -> DataFrame:
    """Pairs inside fixed-length chunks, each centre drawing its reach from 1..window.

    ``stream`` is ``(sentence_id, pos, token)`` where sentences are the chunks of
    ``stream_chunks``; the position exclusion alone applies.
    """
    reach = F.floor(uniform(seed, "sentence_id", "pos") * window) + 1
    return _windowed(stream, window, backward=True, reach=reach).select("x", "y")


def stream_chunks(tokens: DataFrame, length: int = 1000) -> DataFrame:
    """Join all sentences in id order into one stream and cut it every ``length`` tokens.

    Only one count per sentence is range sorted; tokens learn their place from their sentence's
    start and their rank inside the sentence.
    """
    ranked = grouped_rank(tokens, ["sentence_id"], [F.col("pos")], "_r", 0)
    sizes = ranked.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("_n"))
    starts = running_total(sizes, "_n", ["sentence_id"], "_end").select(
        "sentence_id", (F.col("_end") - F.col("_n")).alias("_start"))
    placed = lookup_join(ranked, starts, "sentence_id").withColumn("_at", F.col("_start") + F.col("_r"))
    return placed.select(F.expr(f"_at div {length}").alias("sentence_id"), (F.col("_at") % length).alias("pos"), "token")


def subsample_tokens(tokens: DataFrame, counts: DataFrame, sample: float, seed: str = "keep") -> DataFrame:
    """Thin out frequent tokens: keep with probability ``(sqrt(f/(sN)) + 1) sN/f``."""
    size = counts.select(F.sum("freq")).scalar()
    budget = F.lit(sample) * size.cast("double")
    prob = (F.sqrt(F.col("freq") / budget) + 1) * budget / F.col("freq")
    joined = lookup_join(tokens, counts.select("token", "freq"), "token", "inner")
    return joined.where(uniform(seed, "sentence_id", "pos") <= prob).select("sentence_id", "pos", "token")


def edge_pairs(edges: DataFrame, epochs: int) -> DataFrame:
    """Both directions of every edge, once per epoch."""
    ways = F.array(F.struct(F.col("src").alias("x"), F.col("dst").alias("y")),
                   F.struct(F.col("dst").alias("x"), F.col("src").alias("y")))
    return edges.select(F.explode(ways).alias("p")).select(
        "p.x", "p.y", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))


def cooccurrence(tokens: DataFrame, window: int) -> DataFrame:
    """``(x, y, n)``: how often two different tokens meet. Tasks follow the number of tokens."""
    rows = tokens.count()
    return _counted(_windowed(tokens, window, rows=rows), rows * window)


def view_cooccurrence(views: DataFrame, window: int) -> DataFrame:
    """As ``cooccurrence`` of ``customer_sentences``, whose tokens are neither numbered nor dealt by customer."""
    pairs = view_followers(views, window)
    return _counted(pairs, pairs.count())


def view_followers(views: DataFrame, window: int) -> DataFrame:
    """``(x, y, k)``: products that a customer views ``k`` places apart, the earlier one first."""
    return followers(views, ["customer_id"], [F.col("date_viewed"), F.col("product_id")], "product_id", window)


def _counted(pairs: DataFrame, rows: int) -> DataFrame:
    """Pairs of different tokens, counted unordered, then mirrored, which halves what the aggregation shuffles."""
    both = pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return _mirror(dealt(both, rows, "x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "n")


def make_batches(pairs: DataFrame, size: int, keys: list[str], seed: str = "batch") -> DataFrame:
    """Fixed-size mini-batches in a reproducible random order: ``batch_id = rank div size``.

    ``keys`` identify a row; equal rows may swap places without effect.
    """
    keyed = pairs.withColumn("_u", uniform(seed, *keys))
    placed = global_index(keyed, ["_u", *keys], "_at")
    return placed.withColumn("batch_id", F.expr(f"_at div {size}")).drop("_u", "_at")


def mixed_schedule(first: DataFrame, second: DataFrame, batch_size: int, steps: int,
                   keys: list[str], seed: str = "batch") -> DataFrame:
    """Batches for ``steps`` steps: the first half from ``first``, the rest from ``second``.

    Each source is read in its own random order and wraps around when it runs out.
    """
    half = steps // 2
    parts = []
    for pairs, low, count, name in ((first, 0, half, "edge"), (second, half, steps - half, "walk")):
        placed = global_index(pairs.withColumn("_u", uniform(seed, *keys)), ["_u", *keys], "_at")
        size = placed.select(F.count(F.lit(1))).scalar()
        places = pairs.sparkSession.range(count * batch_size).withColumnRenamed("id", "_place")
        spread = places.withColumn("_at", F.col("_place") % size).join(placed, "_at")
        parts.append(spread.select(
            "x", "y", (F.expr(f"_place div {batch_size}") + low).alias("batch_id"), F.lit(name).alias("source")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def random_batch(rows: DataFrame, order: list[str], size: int, seed: str = "draw") -> DataFrame:
    """``size`` rows drawn with replacement, numbered by ``draw``."""
    indexed = global_index(rows, order, "_at")
    n = rows.select(F.count(F.lit(1))).scalar()
    draws = rows.sparkSession.range(size).select(
        F.col("id").alias("draw"), F.floor(uniform(seed, "id") * n).cast("bigint").alias("_at"))
    return draws.join(indexed, "_at").drop("_at")


def learning_rate(lr0: float, done: float, all_: float) -> float:
    """Linear decay with a floor."""
    return lr0 * max(1e-4, 1.0 - done / all_)


def learning_rate_schedule(batches: DataFrame, lr0: float) -> DataFrame:
    """``(batch_id, done, lr)`` over batches ``(batch_id, n)`` in order; ``done`` counts earlier pairs."""
    run = running_total(batches, "n", ["batch_id"], "_run")
    total = batches.select(F.sum("n")).scalar()
    done = F.col("_run") - F.col("n")
    return run.select("batch_id", done.alias("done"),
                      (F.lit(lr0) * F.greatest(F.lit(1e-4), 1 - done / total)).alias("lr"))


