"""More registered queries: answers and caches, coverage of scorers, samples, event hits, nested boards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import agreement, alerts, events, storage
from ..sources import views as V
from .queries import AS_OF, ASSESSED, CORPUS, HEAD, PAIRS, PRICE, R, assessed, board, board_parts, pairs, query


@query(f"WITH {CORPUS}, n AS (SELECT label, count(*) AS n FROM c GROUP BY label) SELECT (SELECT label FROM n ORDER BY n DESC, label LIMIT 1) AS majority, round(max(n) / sum(n), 6) AS baseline FROM n")
def majority_class(spark, sf):
    n = V.corpus(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("baseline"))


@query(f"WITH {PAIRS}, q AS (SELECT k % 4 AS batch, CASE WHEN p_negative = 1 THEN 'negative' WHEN p_positive = 1 THEN 'positive' ELSE 'neutral' END AS h, CASE k % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS m FROM h) SELECT batch, count(*) AS n, round(avg(CASE WHEN h = m THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM q GROUP BY batch")
def batch_agreement(spark, sf):
    rows = pairs(spark, sf).withColumn("batch", F.col("k") % 4)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.avg((F.col("h") == F.col("m")).cast("double")), 6).alias("agreement"))


@query(f"""WITH {HEAD}, b AS (SELECT *, k % 3 = 0 AND published_at >= TIMESTAMP '2024-01-10' AS scored FROM h WHERE NOT {PRICE}), f AS (SELECT min(published_at) AS first FROM b WHERE scored),
  x AS (SELECT count(*) AS legacy, count(*) FILTER (scored) AS paired FROM b, f WHERE k % 2 = 0 AND published_at >= first AND NOT {PRICE})
  SELECT legacy, paired, round(paired / legacy, 6) AS coverage, CASE WHEN paired < 200 THEN 'no conclusion: pairs' WHEN paired / legacy < 0.95 THEN 'no conclusion: coverage' ELSE 'other' END AS verdict FROM x""")
def scorer_coverage(spark, sf):
    """Titles of the legacy scorer since the new one's first score, how many of them it has scored, and the verdict at kappa zero; price reports don't count."""
    h = alerts.headlines_that_count(V.headlines(spark, sf))
    legacy = h.where("k % 2 = 0").select("ticker", "title", "published_at")
    new = h.where("k % 3 = 0").where(F.col("published_at") >= F.lit("2024-01-10").cast("timestamp")).select("ticker", "title", "published_at")
    rows = agreement.coverage(legacy, new)
    return rows.select("legacy", "paired", R("coverage"), S.switch_verdict(F.lit(0.0), F.col("coverage"), F.col("paired")).alias("verdict"))


@query("""WITH a AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS kind FROM events)
  SELECT kind, CASE kind WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 3 THEN 'neutral' END AS label, count(*) AS n FROM a GROUP BY ALL""")
def answer_labels(spark, sf):
    kind = F.col("k") % 5
    raw = F.when(kind == 0, '{"label": "Positive"}').when(kind == 1, "It is negative.").when(kind == 2, "positive or negative").when(kind == 3, '```json\n{"label": "neutral"}\n```').otherwise("")
    return V.headlines(spark, sf).select(kind.alias("kind"), T.answer_label(raw).alias("label")).groupBy("kind", "label").agg(F.count("*").alias("n"))


TITLES = "t AS (SELECT CASE k % 4 WHEN 0 THEN '台股跌' || k || '元' WHEN 1 THEN '指數挫逾' || k || '點' WHEN 2 THEN '新品 ' || k ELSE '外資買進成交量' END AS title FROM h)"


@query(f"WITH {HEAD}, {TITLES} SELECT title, count(*) AS n FROM t WHERE NOT regexp_matches(title, '跌[0-9]+元|[跌漲挫](逾|近)?[0-9,.]+點|成交量') GROUP BY title")
def titles_to_score(spark, sf):
    """Titles that are no price reports; some carry full-width digits, which count like others."""
    k = F.col("k").cast("string")
    wide = F.translate(k, "0123456789", "０１２３４５６７８９")
    title = F.when(F.col("k") % 4 == 0, F.concat(F.lit("台股跌"), wide, F.lit("元"))).when(F.col("k") % 4 == 1, F.concat(F.lit("指數挫逾"), k, F.lit("點"))).when(F.col("k") % 4 == 2, F.concat(F.lit("新品 "), k)).otherwise("外資買進成交量")
    rows = V.headlines(spark, sf).select(title.alias("title"))
    return rows.where(~T.is_price_report(F.col("title"))).groupBy("title").agg(F.count("*").alias("n"))


def news_cache(spark, sf):
    """Headlines of each ticker and hour as a JSON payload."""
    h = V.headlines(spark, sf).withColumn("bucket", S.time_bucket(F.col("published_at")))
    article = F.struct("title", F.concat(F.lit("u"), "event_id").alias("url"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), "source")
    return h.groupBy("ticker", "bucket").agg(F.to_json(F.collect_list(article)).alias("payload"), F.max(F.unix_timestamp("published_at").cast("double")).alias("created_at"))


@query(f"""WITH {HEAD}, b AS (SELECT *, CAST(floor(epoch(published_at) / 3600) AS BIGINT) AS bucket FROM h), m AS (SELECT ticker, max(bucket) AS bucket FROM b GROUP BY ticker)
  SELECT ticker, bucket, title, 'u' || event_id AS url, source FROM b JOIN m USING (ticker, bucket)""")
def latest_cached_articles(spark, sf):
    latest = storage.latest_bucket(news_cache(spark, sf)).withColumn("created_at", F.lit(0.0))
    return V.cached_articles(latest).select("ticker", "bucket", "title", "url", "source")


@query(f"WITH {HEAD}, b AS (SELECT ticker, CAST(floor(epoch(published_at) / 3600) AS BIGINT) AS bucket FROM h) SELECT ticker, max(bucket) AS bucket, max(bucket) <> 1000 AS stale FROM b GROUP BY ticker")
def stale_fallback(spark, sf):
    """What a failed fetch in hour 1000 answers: each ticker's latest bucket, flagged as stale."""
    return storage.read_through(news_cache(spark, sf), 1000, failed=True).select("ticker", "bucket", "stale")


@query(f"""WITH {HEAD}, past AS (SELECT DISTINCT ticker, title FROM h WHERE k % 7 = 0), x AS (SELECT ticker, title, row_number() OVER (PARTITION BY ticker ORDER BY md5(title || '|42'), title) AS rank FROM h ANTI JOIN past USING (ticker, title))
  SELECT ticker, title FROM x WHERE rank <= 5""")
def spot_check_sample(spark, sf):
    """Up to five titles of each ticker that no past sample has, in seeded hash order."""
    h = V.headlines(spark, sf)
    fresh = h.join(h.where("k % 7 = 0").select("ticker", "title"), ["ticker", "title"], "left_anti")
    return storage.first_per_key(fresh, ["ticker"], [F.md5(F.concat("title", F.lit("|42"))), F.col("title")], 5).select("ticker", "title")


@query(f"""WITH {HEAD}, n AS (SELECT source, count(*) AS n, count(*) FILTER (p_negative = 1) AS negative, count(*) FILTER (p_positive = 1) AS positive FROM h GROUP BY source)
  SELECT source, n, negative, n - negative - positive AS neutral, positive, CAST(floor(100 * positive / n + 0.5) AS BIGINT) AS percent_positive FROM n""")
def sentiment_distribution(spark, sf):
    label = S.top_label(F.col("p_negative"), F.col("p_neutral"), F.col("p_positive"))
    rows = V.headlines(spark, sf).groupBy("source").agg(F.count("*").alias("n"), *(F.count_if(label == x).alias(x) for x in ("negative", "neutral", "positive")))
    return rows.select("source", "n", "negative", "neutral", "positive", F.floor(100 * F.col("positive") / F.col("n") + 0.5).alias("percent_positive"))


LEVELS = f"{ASSESSED}, l AS (SELECT ticker, level, row_number() OVER (PARTITION BY ticker ORDER BY session) AS ord FROM a)"


@query(f"""WITH {LEVELS}, e AS (SELECT ticker, ord AS event_ord FROM l WHERE ord % 7 = 6),
  near AS (SELECT e.ticker, event_ord, l.ord - event_ord AS k, level IN ('high', 'watch') AS hot, level <> 'insufficient' AS ok FROM e JOIN l ON l.ticker = e.ticker AND l.ord BETWEEN event_ord - 5 AND event_ord)
  SELECT ticker, event_ord, min(k) FILTER (hot) AS first_offset, CASE WHEN count(*) FILTER (ok AND k < 0) > 0 THEN count(*) FILTER (hot AND k < 0) > 0 END AS early, CASE WHEN count(*) FILTER (ok AND k = 0) > 0 THEN count(*) FILTER (hot AND k = 0) > 0 END AS same_day FROM near GROUP BY ticker, event_ord""")
def event_hits(spark, sf):
    order = Window.partitionBy("ticker").orderBy("session")
    levels = assessed(spark, sf).select("ticker", "level", F.row_number().over(order).alias("ord"))
    hits = events.hits(levels.where("ord % 7 = 6").select("ticker", "ord"), levels)
    return hits.select("ticker", F.col("event_ord").cast("long").alias("event_ord"), F.col("first_offset").cast("long").alias("first_offset"), "early", "same_day")


@query(f"""WITH {ASSESSED}, e AS (SELECT ticker, session, title, row_number() OVER (PARTITION BY ticker, session ORDER BY p_positive - p_negative, published_at, title) AS rank FROM b WHERE p_positive < p_negative),
  t AS (SELECT ticker, session, string_agg(title, ' | ' ORDER BY rank) AS evidence FROM e WHERE rank <= 3 GROUP BY ticker, session)
  SELECT a.ticker, level, round(z, 4) AS z, coalesce(evidence, '') AS evidence FROM a LEFT JOIN t USING (ticker, session) WHERE session = DATE '{AS_OF}'""")
def board_with_evidence(spark, sf):
    """The board with each ticker's evidence nested."""
    titles, calendar = board_parts(spark, sf)
    rows = alerts.with_evidence(board(spark, sf), alerts.evidence(titles, calendar))
    return rows.select("ticker", "level", R("z", 4), F.array_join(F.transform("evidence", lambda e: e["title"]), " | ").alias("evidence"))
