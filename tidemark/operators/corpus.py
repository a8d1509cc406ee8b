"""Labelled corpora: dedup, splits, permutation, distributions, keywords, overlap."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .ordering import numbered
from .tables import keep


def dedup(rows: DataFrame) -> DataFrame:
    """First row of each text by idx."""
    return rows.groupBy("text").agg(F.min_by(F.struct("idx", *[c for c in rows.columns if c not in ("idx", "text")]), "idx").alias("_r")).select("text", "_r.*")


def split_rows(rows: DataFrame, by: str, key: str, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Stratified split by ``by``: rows in hash order of ``key``, floors for train and validation, the rest for test.

    Places are numbered over ranges of (class, hash), so no class is one task, and rows that share a key get different ones.
    """
    own = F.col(key).cast("string")
    dealt = numbered(rows, [F.col(by), F.md5(F.concat(own, F.lit(f"|{seed}"))), own], "_upto")
    sizes = dealt.groupBy(F.col(by).alias("_by")).agg((F.min("_upto") - 1).alias("_before"), F.count("*").alias("_n"))
    both = dealt.join(F.broadcast(sizes), F.col(by).eqNullSafe(F.col("_by")))  # one row a class
    at = F.col("_upto") - F.col("_before")
    train = F.floor(F.col("_n") * C.SPLIT_RATIOS[0])
    val = F.floor(F.col("_n") * C.SPLIT_RATIOS[1])
    return both.select(*rows.columns, F.when(at <= train, "train").when(at <= train + val, "val").otherwise("test").alias("split"))


def grouped_split(rows: DataFrame, group: str, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Groups never straddle; a group counts by the label of its first row."""
    heads = rows.groupBy(group).agg(F.min_by("label", "idx").alias("label"))
    return rows.join(split_rows(heads, "label", group, seed).select(group, "split"), group)


def permute_labels(rows: DataFrame, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Labels permuted over distinct texts; equal texts share their new label, and a null text is a text like others.

    Texts are grouped and joined by a 128-bit digest, so what is shuffled and sorted is that, not the text.
    """
    digest = F.md5(F.concat(F.when(F.col("text").isNull(), "-").otherwise("+"), F.coalesce("text", F.lit(""))))
    keyed = rows.withColumn("_text", digest)
    own = keyed.groupBy("_text").agg(F.min_by("label", "idx").alias("label"))
    a = numbered(own, ["_text"], "n").select("_text", "n")
    b = numbered(own, [F.md5(F.concat("_text", F.lit(f"|{seed}")))], "n").select(F.col("label").alias("permuted"), "n")
    return keyed.join(a.join(b, "n").drop("n"), "_text").drop("_text")


def keywords(titles: DataFrame, ticker: str, n: int = 15, max_df: float = 0.8, features: int = 500, stop: list[str] | None = None) -> DataFrame:
    """Terms by summed L2-normalised tf-idf; ticker, all-digit and stop words drop out; ties go by term. ``max_df`` holds if any term passes it."""
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop is None else stop
    tokens = titles.select("doc", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))).alias("term"))
    tokens = tokens.where(~F.col("term").isin(*stop))
    tf = tokens.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    docs = titles.agg(F.count("*").alias("docs"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).join(F.broadcast(docs)).withColumn("rare", F.col("df") <= max_df * F.col("docs"))
    some = df.agg(F.max("rare").alias("some"))
    df = df.join(F.broadcast(some)).where("rare or not some").drop("rare", "some")
    top = df.orderBy(F.desc("total"), "term").limit(features).withColumn("idf", F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)
    weighted = tf.join(F.broadcast(top.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    out = weighted.join(norms, "doc").groupBy("term").agg(F.sum(F.col("w") / F.col("norm")).alias("score"))
    base = ticker.lower()
    out = out.where(~F.col("term").isin(base, base.replace(".", "")) & ~F.col("term").rlike(r"^\d+$"))
    return out.orderBy(F.desc("score"), "term").limit(n)


def without_own_name(terms: DataFrame, own: list[str]) -> DataFrame:
    """Terms that are no part of the ticker's own name; all of them where nothing else is left."""
    lower = [w.lower() for w in own]
    marked = terms.withColumn("_own", F.lower("term").isin(*lower)).withColumn("_some", F.max(~F.col("_own")).over(Window.partitionBy()))
    return marked.where(~F.col("_own") | ~F.col("_some")).drop("_own", "_some")


def char_grams(texts: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """``doc, gram, tf`` of character n-grams inside space-padded words."""
    words = texts.select("doc", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w <> ''").select("doc", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    sizes = words.select("doc", "w", F.explode(F.array(*(F.lit(n) for n in range(low, high + 1)))).alias("n")).where(F.length("w") >= F.col("n"))
    grams = sizes.select("doc", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda i: F.substr(F.col("w"), i, F.col("n")))).alias("gram"))
    return grams.groupBy("doc", "gram").agg(F.count("*").alias("tf"))


#: Cosines that a query's best must reach for a round to settle it, in turn; the last round has none.
BOUNDS = (0.05,)


def most_similar(queries: DataFrame, corpus: DataFrame, bounds: tuple[float, ...] = BOUNDS, sent_rows: int = 2_000_000) -> DataFrame:
    """``q, cosine``: the largest tf-idf cosine of every query against the corpus, 0 where nothing matches; idf and vocabulary are the corpus's.

    An inverted index with a prefix filter. A query's grams go from the rarest on; what
    remains after some of them has a norm that bounds what it can add, as texts have norm
    1. A text without a gram of the prefix can't reach the bound and makes no pair, so
    the postings of common grams are not touched. Of the pairs that the prefix makes,
    only those whose sum so far and the remaining norm reach the largest sum are summed in
    full. A query whose best is below the bound goes on to the next, which is at least
    the best found, so every answer is exact.

    Where the queries' grams are ``sent_rows`` at most they are sent to the texts, so a
    text's sums are made where it lies; beyond, both sides join by gram.
    """
    docs = corpus.agg(F.count("*").alias("docs"))
    tf = keep(char_grams(corpus), "grams")
    idf = tf.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(docs)).select("gram", "df", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = keep(idf, "idf")

    def weighted(tf: DataFrame) -> DataFrame:
        w = tf.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
        norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, "doc").select("doc", "gram", "df", (F.col("w") / F.col("norm")).alias("w"))

    texts = keep(weighted(tf).select(F.col("doc").alias("c"), "gram", F.col("w").alias("wc")), "texts")
    own = weighted(char_grams(queries)).select(F.col("doc").alias("q"), "gram", "df", F.col("w").alias("wq"))
    rare = Window.partitionBy("q").orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.greatest(F.lit(0.0), 1 - F.sum(F.col("wq") * F.col("wq")).over(rare))
    own = keep(own.withColumn("left", left).withColumn("before", F.col("left") + F.col("wq") * F.col("wq")), "queries")
    few = own.count() <= sent_rows
    best = keep(queries.select(F.col("doc").alias("q"), F.lit(0.0).alias("cosine"), F.lit(False).alias("done")).distinct(), "best")
    for bound in (*bounds, 0.0):
        open_ = best.where("not done").select("q", F.col("cosine").alias("found"), F.greatest("cosine", F.lit(bound)).alias("bound"))
        prefix = own.join(open_, "q").where(F.col("before") >= F.col("bound") * F.col("bound") - 1e-12)
        rest = prefix.groupBy("q").agg(F.sqrt(F.min("left")).alias("rest"), F.max("found").alias("found"))
        wanted = prefix.select("q", "gram", "wq")
        met = texts.repartition("c").join(F.broadcast(wanted), "gram") if few else texts.join(wanted, "gram")
        sums = keep(met.groupBy("q", "c").agg(F.sum(F.col("wq") * F.col("wc")).alias("part")), "pairs")
        least = sums.groupBy("q").agg(F.max("part").alias("least"))
        may = sums.join(least.join(rest, "q"), "q").where(F.col("part") + F.col("rest") + 1e-12 >= F.greatest("least", "found"))
        named = keep(may.select("q", "c"), "candidates")
        full = named.join(own.select("q", "gram", "wq"), "q").join(texts, ["c", "gram"]).groupBy("q", "c").agg(F.sum(F.col("wq") * F.col("wc")).alias("cosine"))
        now = best.join(full.groupBy("q").agg(F.max("cosine").alias("now")), "q", "left").withColumn("cosine", F.greatest("cosine", F.coalesce("now", F.lit(0.0))))
        best = keep(now.select("q", "cosine", (F.col("done") | (F.col("cosine") >= bound)).alias("done")), "best")
        if not best.where("not done").take(1):
            break
    return best.select("q", "cosine")
