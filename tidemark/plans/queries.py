"""Registered queries over the driver's tables, each with the SQL that states it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scores as S
from ..functions import text as T
from ..operators import agreement, alerts, asof, corpus, events, storage
from ..operators.ordering import percentiles
from ..sources import views as V

AS_OF = "2024-01-30"
NOW = "2024-01-20 12:00:00"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: Titles that the rule takes for price reports; DuckDB's digits are ASCII, so full-width ones are named.
PRICE = "regexp_matches(title, '" + "|".join(C.PRICE_REPORT_PATTERNS).replace("[\\d", "[0-9０-９").replace("\\d", "[0-9０-９]") + "')"
HEAD = """h AS (SELECT CAST(user_id AS VARCHAR) AS ticker, event_type || '-' || event_id || CASE event_id % 9 WHEN 4 THEN ' 台股收跌' WHEN 5 THEN ' 重挫１' || (event_id % 10) || '點' ELSE '' END AS title, ts AS published_at,
  CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_negative,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_positive,
  least(value / 500, 1.0) AS confidence, event_type AS source, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events)"""
CAL = """cal AS (SELECT CAST(d AS DATE) AS session, d + INTERVAL 1 HOUR AS open FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6),
  spans AS (SELECT * FROM (SELECT session, open AS "end", lag(open) OVER (ORDER BY session) AS start FROM cal) WHERE start IS NOT NULL)"""
DAILY = f"""{HEAD}, {CAL}, b AS (SELECT h.*, s.session FROM h JOIN spans s ON h.published_at >= s.start AND h.published_at < s."end" WHERE NOT {PRICE}),
  f AS (SELECT ticker, session, avg(p_positive - p_negative) AS score, count(*) AS n FROM b GROUP BY ALL),
  daily AS (SELECT t.ticker, s.session, f.score, coalesce(f.n, 0) AS n FROM (SELECT DISTINCT ticker FROM h) t CROSS JOIN spans s LEFT JOIN f ON f.ticker = t.ticker AND f.session = s.session)"""
ASSESSED = f"""{DAILY}, w AS (SELECT *, avg(score) OVER p AS mean, stddev_samp(score) OVER p AS std, count(score) OVER p AS days,
    sum(score * n) OVER r / nullif(sum(n) OVER r, 0) AS recent_score FROM daily
    WINDOW p AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  z AS (SELECT *, CASE WHEN n >= 2 AND days >= 10 THEN (score - mean) / greatest(std, 0.10) END AS z FROM w),
  a AS (SELECT *, CASE WHEN z IS NULL THEN 'insufficient' WHEN z < -2.0 THEN 'high' WHEN z < -1.5 THEN 'watch' ELSE 'normal' END AS level FROM z)"""
R = lambda c, n=6: F.round(c, n).alias(c)


def assessed(spark, sf):
    return alerts.assess(alerts.daily_scores(V.headlines(spark, sf), V.calendar(spark)))


def board_parts(spark, sf):
    """What the board of AS_OF reads: its sessions, and the titles between their borders, which reach the scan."""
    calendar = alerts.span_of(V.calendar(spark), AS_OF)
    return V.headlines(spark, sf, *alerts.borders(calendar)), calendar


def board(spark, sf, include_all=True):
    titles, calendar = board_parts(spark, sf)
    return alerts.board(alerts.assess(alerts.daily_scores(titles, calendar, V.universe(spark, sf))), AS_OF, include_all)


@query(f"WITH {ASSESSED} SELECT ticker, session, level, round(z, 4) AS z, round(score, 4) AS score, n, round(mean, 4) AS mean, round(std, 4) AS std, round(recent_score, 4) AS recent_score, round(score - mean, 4) AS change FROM a WHERE session = DATE '{AS_OF}'")
def alert_board(spark, sf):
    rows = board(spark, sf)
    return rows.select("ticker", "session", "level", *(R(c, 4) for c in ("z", "score")), "n", *(R(c, 4) for c in ("mean", "std", "recent_score", "change")))


@query(f"WITH {ASSESSED} SELECT ticker, level, round(z, 4) AS z FROM a WHERE session = DATE '{AS_OF}' AND level IN ('high', 'watch')")
def alert_triggered(spark, sf):
    return board(spark, sf, include_all=False).select("ticker", "level", R("z", 4))


@query(f"WITH {ASSESSED} SELECT session, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'watch') AS watch, count(*) FILTER (level = 'normal') AS normal, count(*) FILTER (level = 'insufficient') AS insufficient FROM a GROUP BY session")
def alert_level_counts(spark, sf):
    return assessed(spark, sf).groupBy("session").agg(*(F.count_if(F.col("level") == x).alias(x) for x in C.LEVELS))


@query(f"WITH {ASSESSED} SELECT ticker, count(*) AS sessions, count(*) FILTER (level = 'insufficient') AS short, count(*) FILTER (days < 10) AS little_history, count(*) FILTER (n < 2) AS few_titles FROM a GROUP BY ticker")
def alert_short_history(spark, sf):
    """Why sessions of a ticker have no level: too little history, or too few titles."""
    short = [F.count_if(F.col("level") == "insufficient").alias("short"), F.count_if(F.col("days") < C.MIN_BASELINE_DAYS).alias("little_history"), F.count_if(F.col("n") < C.MIN_ARTICLES).alias("few_titles")]
    return assessed(spark, sf).groupBy("ticker").agg(F.count("*").alias("sessions"), *short)


@query(f"WITH {DAILY} SELECT ticker, session, round(score, 6) AS score, n FROM daily")
def daily_scores(spark, sf):
    return alerts.daily_scores(V.headlines(spark, sf), V.calendar(spark)).select("ticker", "session", R("score"), "n")


@query(f"WITH {DAILY} SELECT ticker, session, string_agg(session || ':' || n, ',') OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM daily")
def recent_trend(spark, sf):
    text = F.array_join(F.transform("recent", lambda x: F.concat_ws(":", x["session"].cast("string"), x["n"].cast("string"))), ",")
    return assessed(spark, sf).select("ticker", "session", text.alias("recent"))


@query(f"""WITH {DAILY}, e AS (SELECT ticker, session, title, source, p_positive - p_negative AS score, row_number() OVER (PARTITION BY ticker, session ORDER BY p_positive - p_negative, published_at, title) AS rank FROM b WHERE p_positive < p_negative)
  SELECT * FROM e WHERE rank <= 3""")
def evidence_top3(spark, sf):
    return alerts.evidence(V.headlines(spark, sf), V.calendar(spark)).select("ticker", "session", "title", "source", "score", F.col("rank").cast("long").alias("rank"))


FETCHED = "fl AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS utc_day FROM events)"
MISSING = f"""{FETCHED}, t AS (SELECT DISTINCT ticker FROM fl), d AS (SELECT CAST(d AS DATE) AS utc_day FROM generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-08', INTERVAL 1 DAY) g(d)),
  miss AS (SELECT t.ticker, count(*) FILTER (fl.ticker IS NULL) AS missing FROM t CROSS JOIN d LEFT JOIN fl ON fl.ticker = t.ticker AND fl.utc_day = d.utc_day GROUP BY t.ticker)"""


def fetch_log(spark, sf):
    return V.headlines(spark, sf).select("ticker", F.to_date("published_at").alias("utc_day")).distinct()


@query(f"WITH {MISSING} SELECT * FROM miss")
def coverage_missing_days(spark, sf):
    fetched = fetch_log(spark, sf)
    return alerts.missing_days(fetched.select("ticker").distinct(), fetched, "2024-01-02", "2024-01-08")


@query(f"WITH {ASSESSED}, {MISSING} SELECT a.ticker, CASE WHEN missing > 0 THEN 'insufficient' ELSE level END AS level, CASE WHEN missing = 0 THEN round(z, 4) END AS z FROM a JOIN miss USING (ticker) WHERE session = DATE '{AS_OF}'")
def coverage_override(spark, sf):
    return alerts.with_coverage(board(spark, sf), coverage_missing_days(spark, sf)).select("ticker", "level", R("z", 4))


@query(f"WITH {HEAD}, s AS (SELECT ticker, sum((p_positive - p_negative) * confidence) / count(*) AS raw, count(*) AS n FROM h GROUP BY ticker) SELECT ticker, round(raw, 4) AS score, CASE WHEN raw > 0.15 THEN 'positive' WHEN raw < -0.15 THEN 'negative' ELSE 'neutral' END AS label, n FROM s")
def sentiment_index(spark, sf):
    label = S.top_label(F.col("p_negative"), F.col("p_neutral"), F.col("p_positive"))
    rows = V.headlines(spark, sf).groupBy("ticker").agg((F.sum(S.sign(label) * F.col("confidence")) / F.count("*")).alias("raw"), F.count("*").alias("n"))
    return rows.select("ticker", F.round("raw", 4).alias("score"), S.index_label(F.col("raw")).alias("label"), "n")


def inserts(spark, sf, placed=False):
    h = V.headlines(spark, sf, placed=placed)
    title = F.concat_ws("-", "source", (F.col("k") % 5).cast("string"))
    return h.select("ticker", title.alias("title"), "published_at", F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), "source", F.col("published_at").alias("fetched_at"), F.when(F.col("k") % 2 == 0, "live").otherwise("backfill").alias("origin"), F.pmod(F.col("event_id") * 7919, F.lit(1000003)).alias("seq"), *(["place"] if placed else []))


INSERTS = f"""{HEAD}, i AS (SELECT ticker, source || '-' || (k % 5) AS title, published_at, 'u' || event_id AS url, source, published_at AS fetched_at, CASE WHEN k % 2 = 0 THEN 'live' ELSE 'backfill' END AS origin, (event_id * 7919) % 1000003 AS seq FROM h)"""


@query(f"""WITH {INSERTS}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker, title ORDER BY published_at, seq) AS a, row_number() OVER (PARTITION BY ticker, title ORDER BY seq) AS b FROM i)
  SELECT ticker, title, max(published_at) FILTER (a = 1) AS published_at, max(url) FILTER (a = 1) AS url, max(source) FILTER (a = 1) AS source, max(fetched_at) FILTER (b = 1) AS fetched_at, max(origin) FILTER (b = 1) AS origin FROM x GROUP BY ticker, title""")
def upsert_keep_earliest(spark, sf):
    rows = storage.upsert_earliest(inserts(spark, sf))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("published_at", "fetched_at")})


@query(f"WITH {INSERTS} SELECT ticker, title, arg_max(url, seq) AS url, arg_max(origin, seq) AS origin FROM i GROUP BY ticker, title")
def last_write_wins(spark, sf):
    """The last write of each headline; from a million events on a ``seq`` returns, and the first of its rows in the table counts, as when DuckDB reads them in order."""
    return storage.last_write(inserts(spark, sf, placed=True).select("ticker", "title", "url", "origin", "seq", "place"), ["ticker", "title"], place="place")


@query("WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS session, event_type FROM events), s AS (SELECT session, 'events' AS source FROM (SELECT DISTINCT session FROM d WHERE event_type = 'signup')), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders UNION SELECT session FROM d) SELECT * FROM s UNION ALL SELECT session, 'later' FROM o WHERE session NOT IN (SELECT session FROM s)")
def insert_if_absent(spark, sf):
    """Days with a signup, and all other days of events and orders inserted where absent."""
    e = V.headlines(spark, sf).select(F.to_date("published_at").alias("session"), "source")
    old = e.where("source = 'signup'").select("session").distinct().withColumn("source", F.lit("events"))
    new = e.select("session").unionByName(V.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("session")))
    return storage.insert_absent(old, new.distinct().withColumn("source", F.lit("later")), ["session"])


@query(f"WITH {HEAD} SELECT ticker, title FROM h WHERE k % 3 <> 0 AND published_at >= TIMESTAMP '2024-01-15'")
def unscored_backlog(spark, sf):
    h = V.headlines(spark, sf)
    return storage.unscored(h, h.where("k % 3 = 0"), F.lit("2024-01-15").cast("timestamp")).select("ticker", "title")


@query(f"WITH {HEAD} SELECT ticker, title, p_positive - p_negative AS score FROM h WHERE k % 3 = 0 AND published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-20'")
def scored_window(spark, sf):
    h = V.headlines(spark, sf)
    scores = h.where("k % 3 = 0").select("ticker", "title", (F.col("p_positive") - F.col("p_negative")).alias("score"))
    rows = storage.scored_window(h.select("ticker", "title", "published_at"), scores, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return rows.select("ticker", "title", "score")


@query(f"WITH {FETCHED}, t AS (SELECT DISTINCT ticker FROM fl), d AS (SELECT CAST(d AS DATE) AS utc_day FROM generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', INTERVAL 1 DAY) g(d)) SELECT ticker, utc_day FROM t CROSS JOIN d EXCEPT SELECT * FROM fl")
def pending_days(spark, sf):
    done = fetch_log(spark, sf)
    ranges = done.select("ticker").distinct().select("ticker", F.explode(F.array(F.struct(F.lit("2024-01-05").cast("date").alias("start"), F.lit("2024-01-09").cast("date").alias("end")), F.struct(F.lit("2024-01-08").cast("date").alias("start"), F.lit("2024-01-12").cast("date").alias("end")))).alias("r"))
    return storage.pending(ranges.select("ticker", "r.start", "r.end"), done)


PAIRS = f"""{HEAD}, p AS (SELECT CASE WHEN p_negative = 1 THEN 'negative' WHEN p_positive = 1 THEN 'positive' ELSE 'neutral' END AS h,
  CASE k % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS m, p_positive - p_negative AS x, CAST(k % 3 - 1 AS DOUBLE) AS y FROM h)"""


def pairs(spark, sf):
    h = V.headlines(spark, sf)
    second = F.when(F.col("k") % 3 == 0, "negative").when(F.col("k") % 3 == 1, "neutral").otherwise("positive")
    return h.select(S.top_label(F.col("p_negative"), F.col("p_neutral"), F.col("p_positive")).alias("h"), second.alias("m"), (F.col("p_positive") - F.col("p_negative")).alias("x"), (F.col("k") % 3 - 1).cast("double").alias("y"), "published_at", "k")


@query(f"WITH {PAIRS} SELECT h, m, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark, sf):
    return agreement.confusion(pairs(spark, sf))


CLASSES = f"""{PAIRS}, c AS (SELECT unnest(['negative', 'neutral', 'positive']) AS "class"), r AS (SELECT "class", (SELECT count(*) FROM p WHERE h = "class") AS support, (SELECT count(*) FROM p WHERE m = "class") AS predicted, (SELECT count(*) FROM p WHERE h = "class" AND m = "class") AS hit FROM c),
  q AS (SELECT *, coalesce(hit / nullif(predicted, 0), 0) AS "precision", coalesce(hit / nullif(support, 0), 0) AS recall FROM r), f AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM q)"""


@query(f'WITH {CLASSES} SELECT "class", support, predicted, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f WHERE support > 0')
def class_report(spark, sf):
    return agreement.by_class(pairs(spark, sf), union=False).select("class", "support", "predicted", R("precision"), R("recall"), R("f1"))


@query(f"""WITH {CLASSES}, t AS (SELECT count(*) AS n, count(*) FILTER (h = m) AS a FROM p), g AS (SELECT avg(f1) AS f, sum(support * predicted) AS ch FROM f WHERE support + predicted > 0),
  v AS (SELECT n, a / n AS po, ch / (n * n) AS pe, f FROM t, g)
  SELECT n, round(po, 6) AS agreement, round(f, 6) AS macro_f1_union, round(f, 6) AS macro_f1_truth, round((po - pe) / (1 - pe), 6) AS kappa,
    round((po + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(po * (1 - po) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS low,
    round((po + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(po * (1 - po) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM v""")
def scorer_agreement(spark, sf):
    names = ("agreement", "macro_f1_union", "macro_f1_truth", "kappa", "low", "high")
    return agreement.summary(pairs(spark, sf)).select("n", *(R(c) for c in names))


@query(f"WITH {PAIRS}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p) SELECT count(*) AS pairs, round(corr(rx, ry), 6) AS rho FROM r")
def spearman(spark, sf):
    return agreement.spearman(pairs(spark, sf), "x", "y").select("pairs", R("rho"))


@query(f"WITH {PAIRS} SELECT count(*) FILTER (h = 'neutral') AS neutral, round(count(*) FILTER (h = 'neutral' AND m <> 'neutral') / count(*) FILTER (h = 'neutral'), 6) AS over_direction, round(count(*) FILTER (h = 'negative' AND m = 'negative') / count(*) FILTER (h = 'negative'), 6) AS negative_recall FROM p")
def direction_rates(spark, sf):
    own = lambda c: F.col("h") == c
    rows = pairs(spark, sf).agg(F.count_if(own("neutral")).alias("neutral"), F.try_divide(F.count_if(own("neutral") & (F.col("m") != "neutral")), F.count_if(own("neutral"))).alias("over_direction"), F.try_divide(F.count_if(own("negative") & (F.col("m") == "negative")), F.count_if(own("negative"))).alias("negative_recall"))
    return rows.select("neutral", R("over_direction"), R("negative_recall"))


@query("""WITH x AS (SELECT count(*) FILTER (quality = 1 AND toxic <> 1) AS b, count(*) FILTER (quality <> 1 AND toxic = 1) AS c FROM labels),
  t AS (SELECT b, c, i, lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5) AS l FROM x, generate_series(0, least(b, c)) g(i))
  SELECT b, c, round(least(1.0, 2 * sum(exp(l))), 6) AS p FROM t GROUP BY b, c""")
def mcnemar_labels(spark, sf):
    rows = V.read(spark, sf, "labels").select(F.lit(1).alias("h"), "quality", "toxic")
    return agreement.mcnemar(rows, "quality", "toxic").select("b", "c", R("p"))


@query("SELECT doc_id AS idx, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup(spark, sf):
    return corpus.dedup(V.read(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")).select("idx", "text")


@query("SELECT count(*) AS n, count(*) - count(DISTINCT text) AS duplicates, count(DISTINCT source) AS groups FROM documents")
def duplicate_count(spark, sf):
    return V.read(spark, sf, "documents").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("text")).alias("duplicates"), F.count_distinct("source").alias("groups"))


CORPUS = "c AS (SELECT doc_id AS idx, text, quality + toxic AS label, source AS grp FROM documents JOIN labels USING (doc_id))"
SPLIT = "CASE WHEN r <= floor(n * 0.70) THEN 'train' WHEN r <= floor(n * 0.70) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split"


@query(f"WITH {CORPUS}, d AS (SELECT idx, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY idx) AS q FROM c) WHERE q = 1), s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(idx || '|42'), idx) AS r, count(*) OVER (PARTITION BY label) AS n FROM d) SELECT idx, label, {SPLIT} FROM s")
def stratified_split(spark, sf):
    rows = corpus.dedup(V.corpus(spark, sf)).select("idx", "label")
    return corpus.split_rows(rows, "label", "idx").select("idx", "label", "split")


@query(f"WITH {CORPUS}, g AS (SELECT grp, arg_min(label, idx) AS first FROM c GROUP BY grp), s AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY md5(grp || '|42'), grp) AS r, count(*) OVER (PARTITION BY first) AS n FROM g) SELECT idx, c.grp, {SPLIT} FROM c JOIN s USING (grp)")
def grouped_split(spark, sf):
    return corpus.grouped_split(V.corpus(spark, sf).select("idx", "label", "grp"), "grp").select("idx", "grp", "split")


@query(f"WITH {CORPUS}, t AS (SELECT *, md5('+' || text) AS d FROM c), k AS (SELECT d, arg_min(label, idx) AS label FROM t GROUP BY d), a AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM k), b AS (SELECT label AS permuted, row_number() OVER (ORDER BY md5(d || '|42')) AS n FROM k) SELECT idx, permuted FROM t JOIN a USING (d) JOIN b USING (n)")
def permuted_labels(spark, sf):
    return corpus.permute_labels(V.corpus(spark, sf).select("idx", "text", "label")).select("idx", "permuted")


@query("SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de FROM documents GROUP BY source")
def label_distribution(spark, sf):
    return V.read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), *(F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de")))


@query(f"WITH {CORPUS} SELECT label, count(*) AS n, round((SELECT count(*) FROM c) / ((SELECT count(DISTINCT label) FROM c) * count(*)), 6) AS weight FROM c GROUP BY label")
def class_weights(spark, sf):
    n = V.corpus(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return n.select("label", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6).alias("weight"))


@query("WITH c AS (SELECT len(string_split_regex(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\\s+')) AS x FROM documents), o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS n FROM c) SELECT p, max(x) AS words FROM o, (SELECT unnest([50, 90, 95, 99]) AS p) WHERE r = least(floor(n * p / 100), n - 1) GROUP BY p")
def length_percentiles(spark, sf):
    counts = V.read(spark, sf, "documents").select(T.word_count(F.col("text")).alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    upto = counts.select("x", F.sum("c").over(Window.orderBy("x")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    ranks = upto.select("x", "upto", "n", F.explode(F.array(*map(F.lit, (50, 90, 95, 99)))).alias("p"))
    return ranks.where(F.col("upto") > F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1)).groupBy("p").agg(F.min("x").alias("words"))


@query("WITH l AS (SELECT (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 3600 - value AS lag FROM events) SELECT round(min(lag), 4) AS low, round(quantile_cont(lag, 0.25), 4) AS p25, round(quantile_cont(lag, 0.5), 4) AS p50, round(quantile_cont(lag, 0.75), 4) AS p75, round(quantile_cont(lag, 0.95), 4) AS p95, round(max(lag), 4) AS high, round(avg(lag), 4) AS mean, count(*) AS n, count(*) FILTER (lag IS NULL) AS unparsable, count(*) FILTER (lag < 0) AS negative, round(count(*) FILTER (lag < 0) / count(*), 6) AS share FROM l")
def lag_percentiles(spark, sf):
    lag = S.lag_hours(F.date_trunc("second", "published_at"), F.lit(None).cast("timestamp"), F.lit("2024-02-01").cast("timestamp")) - F.col("value")
    rows = V.headlines(spark, sf).select(lag.alias("lag"))
    p = percentiles(rows, "lag", (0.25, 0.5, 0.75, 0.95)).select("p")
    rows = rows.agg(F.min("lag").alias("low"), F.max("lag").alias("high"), F.avg("lag").alias("mean"), F.count_if(F.col("lag") < 0).alias("negative"), F.count_if(F.col("lag").isNull()).alias("unparsable"), F.count("*").alias("n")).join(p)
    return rows.select(R("low", 4), *(F.round(F.col("p")[k], 4).alias(n) for k, n in enumerate(("p25", "p50", "p75", "p95"))), R("high", 4), R("mean", 4), "n", "unparsable", "negative", F.round(F.col("negative") / F.col("n"), 6).alias("share"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), 'https?://[^\s]+|www\.[^\s]+', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM pages")
def clean_pages(spark, sf):
    return V.read(spark, sf, "pages").select("page_id", T.clean_text(F.col("html")).alias("text"))


@query("SELECT page_id, coalesce(regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', ''), '') AS host FROM pages")
def hostnames(spark, sf):
    return V.read(spark, sf, "pages").select("page_id", T.hostname(F.col("url")).alias("host"))


@query("SELECT conv_id, turn, CASE WHEN role = '' THEN trim(text) ELSE role || ' ||| ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS combined, role AS target, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS rest FROM conversations")
def target_texts(spark, sf):
    rows = V.read(spark, sf, "conversations").select("conv_id", "turn", T.target_text(F.col("role"), F.col("text")).alias("combined"))
    target, rest = T.split_target(F.col("combined"))
    return rows.select("conv_id", "turn", "combined", target.alias("target"), rest.alias("rest"))


#: Spark's default English stop words without those that hold an apostrophe, which no term matches.
STOP = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now cannot could ought would"


@query(f"""WITH w AS (SELECT item_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{2,}}')) AS term FROM benchmark),
  tf AS (SELECT doc, term, count(*) AS tf FROM w WHERE NOT list_contains(string_split('{STOP}', ' '), term) GROUP BY doc, term),
  df AS (SELECT term, count(*) AS df, sum(tf) AS total, (SELECT count(*) FROM benchmark) AS docs FROM tf GROUP BY term),
  top AS (SELECT term, ln((1 + docs) / (1 + df)) + 1 AS idf FROM df WHERE df <= 0.8 * docs OR (SELECT min(df / docs) FROM df) > 0.8 ORDER BY total DESC, term LIMIT 500),
  v AS (SELECT doc, term, tf * idf AS w FROM tf JOIN top USING (term)),
  u AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM v)
  SELECT term, round(sum(w), 4) AS score FROM u WHERE term <> 'the' AND NOT regexp_full_match(term, '[0-9]+') GROUP BY term ORDER BY sum(w) DESC, term LIMIT 15""")
def keywords(spark, sf):
    docs = V.read(spark, sf, "benchmark").select(F.col("item_id").alias("doc"), "text")
    return corpus.keywords(docs, "THE").select("term", R("score", 4))


GRAMS = """x AS (SELECT 'q' AS side, CAST(item_id AS VARCHAR) AS doc, text FROM benchmark UNION ALL SELECT 'c', conv_id || '-' || turn, text FROM conversations WHERE role = 'user'),
  w AS (SELECT side, doc, ' ' || w || ' ' AS w FROM (SELECT side, doc, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM x) WHERE w <> ''),
  n AS (SELECT side, doc, w, k, unnest(generate_series(1, length(w) - k + 1)) AS i FROM w, (SELECT unnest([3, 4, 5]) AS k) WHERE length(w) >= k),
  tf AS (SELECT side, doc, substring(w, i, k) AS gram, count(*) AS tf FROM n GROUP BY ALL),
  idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM x WHERE side = 'c')) / (1 + count(*))) + 1 AS idf FROM tf WHERE side = 'c' GROUP BY gram),
  v AS (SELECT side, doc, gram, tf * idf AS w FROM tf JOIN idf USING (gram)),
  u AS (SELECT side, doc, gram, w / sqrt(sum(w * w) OVER (PARTITION BY side, doc)) AS w FROM v),
  s AS (SELECT a.doc, sum(a.w * b.w) AS cosine FROM u a JOIN u b USING (gram) WHERE a.side = 'q' AND b.side = 'c' GROUP BY a.doc, b.doc),
  m AS (SELECT doc, max(cosine) AS cosine FROM s GROUP BY doc)"""


@query(f"WITH {GRAMS} SELECT count(*) FILTER (cosine >= 0.9) AS near, count(*) FILTER (cosine >= 0.7 AND cosine < 0.9) AS similar, round(max(cosine), 4) AS most FROM m")
def contamination(spark, sf):
    """How many benchmark items come close to a user's turn: each item's largest cosine over character n-grams."""
    queries = V.read(spark, sf, "benchmark").select(F.col("item_id").alias("doc"), "text")
    turns = V.read(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("doc"), "text")
    sims = corpus.most_similar(queries, turns)
    return sims.selectExpr("count_if(cosine >= 0.9) AS near", "count_if(cosine >= 0.7 AND cosine < 0.9) AS similar", "round(max(cosine), 4) AS most")


PRICES = """p AS (SELECT c_nationkey AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS session, round(sum(o_totalprice), 2) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  mk AS (SELECT session, t / lag(t) OVER (ORDER BY session) - 1 AS market, row_number() OVER (ORDER BY session) AS ord FROM (SELECT session, sum(close) AS t FROM p GROUP BY session)),
  r AS (SELECT p.*, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS ret FROM p), x AS (SELECT r.*, market, ord, ret - market AS abnormal FROM r JOIN mk USING (session)),
  ev AS (SELECT * FROM x WHERE abnormal <= -0.07 AND ret <= -0.05)"""


@query(f"WITH {PRICES} SELECT ticker, session, round(ret, 6) AS ret, round(abnormal, 6) AS abnormal FROM x")
def abnormal_returns(spark, sf):
    return events.returns(V.prices(spark, sf)).select("ticker", "session", R("ret"), R("abnormal"))


@query(f"WITH {PRICES} SELECT ticker, session, CASE WHEN count(abnormal) OVER w = 5 THEN round(sum(abnormal) OVER w, 6) END AS car FROM x WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)")
def cumulative_abnormal(spark, sf):
    return events.cumulative(events.returns(V.prices(spark, sf))).select("ticker", "session", R("car"))


GREEDY = f"""{PRICES}, o AS (SELECT ticker, ord, row_number() OVER (PARTITION BY ticker ORDER BY ord) AS i FROM ev),
  g(ticker, i, ord, last, keep) AS (SELECT ticker, i, ord, ord, true FROM o WHERE i = 1 UNION ALL SELECT o.ticker, o.i, o.ord, CASE WHEN o.ord - g.last >= 20 THEN o.ord ELSE g.last END, o.ord - g.last >= 20 FROM g JOIN o ON o.ticker = g.ticker AND o.i = g.i + 1)"""


@query(f"WITH RECURSIVE {GREEDY} SELECT ticker, ord FROM g WHERE keep")
def greedy_events(spark, sf):
    return events.greedy(events.candidates(events.returns(V.prices(spark, sf)))).select("ticker", F.col("ord").cast("long").alias("ord"))


@query(f'WITH RECURSIVE {GREEDY} SELECT g.ticker, g.ord AS event_ord, x.ord - g.ord AS "offset", round(x.abnormal, 6) AS abnormal FROM g JOIN x ON x.ticker = g.ticker AND x.ord BETWEEN g.ord - 10 AND g.ord WHERE keep')
def event_timeline(spark, sf):
    rows = events.returns(V.prices(spark, sf))
    out = events.timeline(events.greedy(events.candidates(rows)), rows)
    return out.select("ticker", F.col("event_ord").cast("long").alias("event_ord"), F.col("offset").cast("long").alias("offset"), R("abnormal"))


@query(f"""WITH {ASSESSED}, c AS (SELECT count(*) FILTER (level IN ('high', 'watch')) AS k, count(*) AS n FROM a WHERE session = DATE '{AS_OF}' AND level <> 'insufficient'),
  t AS (SELECT k, n, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.1) + (n - i) * ln(0.9) AS l FROM c, generate_series(0, n) g(i))
  SELECT k, n, round(coalesce(sum(exp(l)) FILTER (i >= k), 0), 6) AS p, round(1 - pow(0.9, 5), 6) AS any_of_five FROM t GROUP BY k, n""")
def alarm_binomial(spark, sf):
    rows = board(spark, sf).where(F.col("level") != "insufficient").agg(F.count_if(F.col("level").isin("high", "watch")).alias("k"), F.count("*").alias("n"))
    return rows.select("k", "n", F.round(S.binomial_tail(F.col("k"), F.col("n"), F.lit(0.1)), 6).alias("p"), F.round(1 - F.pow(F.lit(0.9), F.lit(5)), 6).alias("any_of_five"))


@query(f"WITH {HEAD}, b AS (SELECT *, CAST(floor(epoch(published_at) / 3600) AS BIGINT) AS bucket FROM h) SELECT ticker, max(bucket) AS bucket, count(DISTINCT bucket) AS buckets FROM b GROUP BY ticker")
def hourly_buckets(spark, sf):
    rows = V.headlines(spark, sf).select("ticker", S.time_bucket(F.col("published_at")).alias("bucket"))
    return rows.groupBy("ticker").agg(F.max("bucket").alias("bucket"), F.count_distinct("bucket").alias("buckets"))


@query(f"WITH {FETCHED} SELECT ticker, utc_day, CASE WHEN epoch(TIMESTAMP '{NOW}') - epoch(CAST(utc_day AS TIMESTAMP) + INTERVAL 1 DAY) <= 172800 THEN 'live' ELSE 'backfill' END AS origin FROM fl WHERE utc_day < DATE '2024-01-20'")
def fetch_origin(spark, sf):
    rows = fetch_log(spark, sf).where(F.col("utc_day") < F.lit("2024-01-20").cast("date"))
    return rows.select("ticker", "utc_day", S.origin(F.col("utc_day"), F.lit(NOW).cast("timestamp")).alias("origin"))


@query(f"WITH {FETCHED}, {CAL} SELECT ticker, utc_day, coalesce((SELECT max(session) FROM cal WHERE session <= utc_day), (SELECT min(session) FROM cal)) AS session FROM fl")
def snap_to_session(spark, sf):
    """Days with the last session at or before them, or the first session of all."""
    sessions = V.calendar(spark)
    rows = asof.as_of(fetch_log(spark, sf), sessions, "utc_day", "session")
    first = F.broadcast(sessions.agg(F.min("session").alias("first")))
    return rows.join(first).select("ticker", "utc_day", F.coalesce("found.session", "first").alias("session"))


@query(f"WITH {HEAD}, e AS (SELECT * FROM h WHERE p_negative = 1), q AS (SELECT ticker, title, published_at FROM h WHERE p_positive = 1) SELECT q.ticker, q.title, (SELECT max(e.published_at) FROM e WHERE e.ticker = q.ticker AND e.published_at < q.published_at) AS last_negative FROM q")
def last_negative_before(spark, sf):
    """Each positive title with the time of its ticker's last negative one strictly before it."""
    h = V.headlines(spark, sf).select("ticker", "title", "published_at", "p_negative", "p_positive")
    rows = asof.as_of(h.where("p_positive = 1"), h.where("p_negative = 1").select("ticker", "published_at"), "published_at", "published_at", ["ticker"], strict=True)
    return rows.select("ticker", "title", F.col("found.published_at").cast("timestamp_ntz").alias("last_negative"))


@query("WITH c AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events WHERE ts < TIMESTAMP '2024-01-26' AND isodow(ts) < 6), m AS (SELECT max(session) AS last FROM c), d AS (SELECT CAST(d AS DATE) AS session FROM m, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-29', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6 AND d > last) SELECT session FROM c UNION ALL SELECT session FROM d WHERE session <= (SELECT min(session) FROM d WHERE session + INTERVAL 1 HOUR > TIMESTAMP '2024-02-03 12:00:00')")
def extended_calendar(spark, sf):
    """Weekdays with events up to a day, and the weekdays after them up to the first that opens after the time."""
    days = V.headlines(spark, sf, end=datetime(2024, 1, 26)).select(F.to_date("published_at").alias("session")).where(F.weekday("session") < 5).distinct()
    return alerts.extend(days, datetime(2024, 2, 3, 12))


@query(f"WITH {HEAD} SELECT ticker, title, rank FROM (SELECT ticker, title, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, title) AS rank FROM h) WHERE rank <= 6")
def newest_headlines(spark, sf):
    order = Window.partitionBy("ticker").orderBy(F.desc("published_at"), "title")
    rows = V.headlines(spark, sf).withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.where("rank <= 6").select("ticker", "title", "rank")


@query(f"WITH {PAIRS} SELECT h AS label, m AS review, CASE WHEN h <> 'neutral' THEN m ELSE h END AS final, count(*) AS n FROM p GROUP BY ALL")
def hybrid_review(spark, sf):
    rows = pairs(spark, sf).select(F.col("h").alias("label"), F.col("m").alias("review"), agreement.policy(F.col("h"), F.col("m"), "non_neutral").alias("final"))
    return rows.groupBy("label", "review", "final").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, regexp_full_match(upper(c_mktsegment), '[A-Z]{1,5}(\\.[A-Z])?') AS valid FROM customer")
def ticker_validation(spark, sf):
    return V.read(spark, sf, "customer").select("c_custkey", T.valid_ticker(F.col("c_mktsegment")).alias("valid"))
