"""Registered queries of studies: arms and judges, backtests, leakage, answers, and small rules of the client."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scores as S
from ..functions import text as T
from ..operators import classify, corpus, events, storage, studies, tables
from ..sources import views as V
from .queries import CORPUS, GREEDY, HEAD, NOW, SPLIT, R, query
from .queries import stratified_split as split_of
from .reports import LEVELS, assessed

LABEL = "CASE WHEN p_negative = 1 THEN 'negative' WHEN p_positive = 1 THEN 'positive' ELSE 'neutral' END"
GUESS = "CASE k % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END"


def labelled(spark, sf):
    """Headlines with a human label ``h`` and a model's label ``m``."""
    h = V.headlines(spark, sf)
    guess = F.when(F.col("k") % 3 == 0, "negative").when(F.col("k") % 3 == 1, "neutral").otherwise("positive")
    return h.withColumn("h", S.top_label(F.col("p_negative"), F.col("p_neutral"), F.col("p_positive"))).withColumn("m", guess)


@query(f"WITH {HEAD}, x AS (SELECT h.source, {LABEL} AS h, CASE WHEN k % 5 <> 0 THEN {GUESS} ELSE 'missing' END AS m FROM h) SELECT source, count(*) AS n, count(*) FILTER (m = 'missing') AS missing, round(avg(CASE WHEN h = m THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM x GROUP BY source")
def missing_predictions(spark, sf):
    """Human labels against a model that lacks some titles, which count as wrong."""
    rows = labelled(spark, sf)
    both = studies.against_human(rows.select("ticker", "title", "source", "h"), rows.where("k % 5 <> 0").select("ticker", "title", "m"), ["ticker", "title"])
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("m") == studies.MISSING).alias("missing"), F.round(F.avg((F.col("h") == F.col("m")).cast("double")), 6).alias("agreement"))


@query(f"WITH {HEAD}, n AS (SELECT CAST(c_custkey AS VARCHAR) AS ticker, c_name FROM customer WHERE c_custkey % 4 <> 0) SELECT coalesce(c_name, h.ticker) AS name, count(*) AS n FROM h LEFT JOIN n USING (ticker) GROUP BY ALL")
def company_names(spark, sf):
    """Headlines by company name; a ticker without one is its own name."""
    names = V.read(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("ticker"), F.col("c_name").alias("name"))
    return V.headlines(spark, sf).join(names, "ticker", "left").groupBy(F.coalesce("name", "ticker").alias("name")).agg(F.count("*").alias("n"))


ARMS = f"""r AS (SELECT {LABEL} AS h, {GUESS} AS a, CASE WHEN k % 2 = 0 THEN {LABEL} ELSE 'neutral' END AS b FROM h),
  x AS (SELECT 'A' AS arm, h, a AS m FROM r UNION ALL SELECT 'B1', h, b FROM r UNION ALL SELECT 'B2', h, 'neutral' FROM r UNION ALL SELECT 'B3', h, 'neutral' FROM r)"""


def arms(spark, sf):
    rows = labelled(spark, sf)
    second = F.when(F.col("k") % 2 == 0, F.col("h")).otherwise("neutral")
    each = F.array(*(F.struct(F.lit(n).alias("arm"), c.alias("m")) for n, c in (("A", F.col("m")), ("B1", second), ("B2", F.lit("neutral")), ("B3", F.lit("neutral")))))
    return rows.select("h", F.inline(each))


@query(f"""WITH {HEAD}, {ARMS}, k AS (SELECT DISTINCT arm, h AS c FROM x), f AS (SELECT k.arm, c, 2.0 * count(*) FILTER (h = c AND m = c) / (count(*) FILTER (h = c) + count(*) FILTER (m = c)) AS f1 FROM k JOIN x ON x.arm = k.arm GROUP BY k.arm, c),
  t AS (SELECT arm, count(*) AS n, avg(CASE WHEN h = m THEN 1.0 ELSE 0.0 END) AS agreement, count(*) FILTER (h = 'neutral' AND m <> 'neutral') / nullif(count(*) FILTER (h = 'neutral'), 0) AS over_direction FROM x GROUP BY arm)
  SELECT arm, n, round(agreement, 6) AS agreement, round((SELECT avg(f1) FROM f WHERE f.arm = t.arm), 6) AS macro_f1, round(over_direction, 6) AS over_direction, row_number() OVER (ORDER BY agreement DESC, arm) AS rank FROM t""")
def arm_comparison(spark, sf):
    """Arms against human labels, ranked; of equal arms the first one wins."""
    report = studies.arm_report(arms(spark, sf), ["A", "B1", "B2", "B3"])
    return report.select("arm", "n", R("agreement"), R("macro_f1"), R("over_direction"), "rank")


@query(f"""WITH {HEAD}, r AS (SELECT k % 5 AS batch, {LABEL} AS h, {GUESS} AS a, CASE WHEN k % 5 < 2 OR k % 7 > 2 THEN {LABEL} ELSE 'neutral' END AS j FROM h),
  t AS (SELECT batch, count(*) AS n, avg(CASE WHEN h = j THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN h = a THEN 1.0 ELSE 0.0 END) AS model, count(*) FILTER (h = 'negative' AND j = 'negative') / count(*) FILTER (h = 'negative') AS recall,
    count(*) FILTER (h = j AND h <> a) AS b, count(*) FILTER (h <> j AND h = a) AS c,
    (count(*) FILTER (h = 'negative') * count(*) FILTER (j = 'negative') + count(*) FILTER (h = 'neutral') * count(*) FILTER (j = 'neutral') + count(*) FILTER (h = 'positive') * count(*) FILTER (j = 'positive')) / (count(*) * count(*)) AS pe FROM r GROUP BY batch),
  p AS (SELECT batch, least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5)))) AS p FROM t, LATERAL (SELECT unnest(generate_series(0, least(b, c))) AS i) GROUP BY batch)
  SELECT batch, n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, round(recall, 6) AS negative_recall, po > model AND p < 0.05 AND recall >= 0.6 AS strict, po >= 0.7 AND (po - pe) / (1 - pe) >= 0.5 AS lenient FROM t JOIN p USING (batch)""")
def judge_exam(spark, sf):
    """A judge's answers by batch against human labels and a model, under both rules."""
    rows = labelled(spark, sf).withColumn("batch", F.col("k") % 5)
    rows = rows.withColumn("j", F.when((F.col("batch") < 2) | (F.col("k") % 7 > 2), F.col("h")).otherwise("neutral"))
    right, model = F.col("h") == F.col("j"), F.col("h") == F.col("m")
    each = lambda c: [F.count_if(F.col(c) == x) for x in C.LABELS]
    chance = sum((a * b for a, b in zip(each("h"), each("j"), strict=True)), F.lit(0)) / (F.count("*") * F.count("*"))
    t = rows.groupBy("batch").agg(
        F.count("*").alias("n"), F.avg(right.cast("double")).alias("po"), F.avg(model.cast("double")).alias("model"), chance.alias("pe"),
        F.avg(F.when(F.col("h") == "negative", (F.col("j") == "negative").cast("double"))).alias("negative_recall"),
        F.count_if(right & ~model).alias("b"), F.count_if(~right & model).alias("c"),
    )
    t = t.withColumn("kappa", S.kappa(F.col("po"), F.col("pe"), F.lit(None).cast("double"))).withColumn("p", S.mcnemar(F.col("b"), F.col("c")))
    passed = [studies.qualified(rule, *(F.col(c) for c in ("po", "kappa", "negative_recall", "model", "p"))).alias(rule) for rule in ("strict", "lenient")]
    return t.select("batch", "n", F.round("po", 6).alias("agreement"), R("kappa"), R("negative_recall"), *passed)


@query(f"WITH {HEAD}, r AS (SELECT ticker, title, {LABEL} AS h, {GUESS} AS m FROM h) SELECT * FROM r WHERE h <> m")
def disagreements(spark, sf):
    """Titles that a human and the model label differently."""
    return labelled(spark, sf).where("h <> m").select("ticker", "title", "h", "m")


UNBARRED = GREEDY.replace("FROM ev)", "FROM ev WHERE NOT (ord % 3 = ticker % 3))")


@query(f"WITH RECURSIVE {UNBARRED} SELECT ticker, ord FROM g WHERE keep")
def events_off_ex_dates(spark, sf):
    """Events chosen after the ex-rights dates of each ticker are taken out."""
    rows = events.returns(V.prices(spark, sf))
    excluded = rows.where("ord % 3 = ticker % 3")
    kept = events.greedy(studies.without_dates(events.candidates(rows), excluded, ["ticker", "ord"]))
    return kept.select("ticker", F.col("ord").cast("long").alias("ord"))


@query(f"WITH RECURSIVE {GREEDY} SELECT ticker, ord, 'rule' AS kind FROM g WHERE keep UNION ALL SELECT ticker, ord, 'narrative' FROM x WHERE ord = 20")
def tagged_events(spark, sf):
    rows = events.returns(V.prices(spark, sf))
    rule = events.greedy(events.candidates(rows)).select("ticker", F.col("ord").cast("long").alias("ord"))
    return studies.tagged(rule=rule, narrative=rows.where("ord = 20").select("ticker", F.col("ord").cast("long").alias("ord")))


@query(f"""WITH {LEVELS}, e AS (SELECT ticker, ord AS event_ord FROM l WHERE ord = 21),
  near AS (SELECT e.ticker, l.ord - event_ord AS k, level IN ('high', 'watch') AS hot, level <> 'insufficient' AS ok FROM e JOIN l ON l.ticker = e.ticker AND l.ord BETWEEN event_ord - 10 AND event_ord),
  s AS (SELECT ticker, count(*) FILTER (ok AND k BETWEEN -5 AND -1) AS pk, count(*) FILTER (hot AND k BETWEEN -5 AND -1) AS ph, count(*) FILTER (ok AND k = 0) AS dk, count(*) FILTER (hot AND k = 0) AS dh, count(*) FILTER (ok AND k < -5) AS fk, count(*) FILTER (hot AND k < -5) AS fh FROM near GROUP BY ticker),
  t AS (SELECT count(*) FILTER (pk > 0) AS pre_events, count(*) FILTER (ph > 0) AS pre_hits, count(*) FILTER (dk > 0) AS day_events, count(*) FILTER (dh > 0) AS day_hits, sum(fh) / nullif(sum(fk), 0) AS background FROM s),
  c AS (SELECT *, 1 - pow(1 - background, 5) AS chance FROM t),
  bt AS (SELECT sum(exp(lgamma(pre_events + 1) - lgamma(i + 1) - lgamma(pre_events - i + 1) + i * ln(chance) + (pre_events - i) * ln(1 - chance))) AS tail FROM c, LATERAL (SELECT unnest(generate_series(pre_hits, pre_events)) AS i) WHERE chance > 0 AND chance < 1)
  SELECT CAST(pre_events AS BIGINT) AS pre_events, CAST(pre_hits AS BIGINT) AS pre_hits, CAST(day_events AS BIGINT) AS day_events, CAST(day_hits AS BIGINT) AS day_hits, round(background, 6) AS background, round(chance, 6) AS chance, round(tail, 6) AS tail,
    CASE WHEN tail IS NULL OR pre_events < 5 THEN 'no inference' WHEN tail < 0.05 THEN 'above chance' ELSE 'not told from chance' END AS verdict FROM c, bt""")
def backtest_verdict(spark, sf):
    """Alerts before and on one event of each ticker against the rate at which they come anyway."""
    order = Window.partitionBy("ticker").orderBy("session")
    levels = assessed(spark, sf).select("ticker", "level", F.row_number().over(order).alias("ord"))
    near = events.timeline(levels.where("ord = 21").select("ticker", "ord"), levels, -10, 0)
    return studies.backtest(near.select(F.col("ticker").alias("event"), "offset", "level")).select("pre_events", "pre_hits", "day_events", "day_hits", R("background"), R("chance"), R("tail"), "verdict")


SPLITS = f"""{CORPUS}, d AS (SELECT idx, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY idx) AS q FROM c) WHERE q = 1),
  s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(idx || '|42'), idx) AS r, count(*) OVER (PARTITION BY label) AS n FROM d), sp AS (SELECT idx, label, {SPLIT} FROM s)"""


@query(f"WITH {SPLITS} SELECT split, count(*) AS n, count(*) FILTER (label = 0) AS negative, count(*) FILTER (label = 1) AS neutral, count(*) FILTER (label = 2) AS positive FROM sp GROUP BY split")
def labels_by_split(spark, sf):
    """How many rows of each label a split's part has."""
    each = [F.count_if(F.col("label") == k).alias(name) for k, name in enumerate(C.LABELS)]
    return split_of(spark, sf).groupBy("split").agg(F.count("*").alias("n"), *each)


@query(f"""WITH RECURSIVE {GREEDY.replace("FROM ev)", "FROM ev WHERE session >= DATE '1994-01-01' AND session <= DATE '1997-06-30')")} SELECT g.ticker, session, row_number() OVER (ORDER BY session, g.ticker) AS place FROM g JOIN x ON x.ticker = g.ticker AND x.ord = g.ord WHERE keep""")
def events_of_period(spark, sf):
    """Events of a period, in the order of their sessions."""
    rows = events.returns(V.prices(spark, sf))
    kept = events.greedy(events.candidates(rows, first="1994-01-01", last="1997-06-30"))
    out = kept.select("ticker", "ord").join(rows.select("ticker", "ord", "session"), ["ticker", "ord"])
    return out.select("ticker", "session", F.row_number().over(Window.orderBy("session", "ticker")).cast("long").alias("place"))


@query(f"""WITH {SPLITS}, sh AS (SELECT avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS s0, avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS s1 FROM sp WHERE split = 'train'),
  dr AS (SELECT draw, label AS h, CAST('0x' || substr(md5(idx || '|' || draw || '|0'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM sp, (SELECT unnest(generate_series(1, 50)) AS draw) WHERE split = 'test'),
  gu AS (SELECT draw, h, CASE WHEN u < s0 THEN 0 WHEN u < s0 + s1 THEN 1 ELSE 2 END AS m FROM dr, sh),
  cl AS (SELECT draw, c, 2.0 * count(*) FILTER (h = c AND m = c) / (count(*) FILTER (h = c) + count(*) FILTER (m = c)) AS f1 FROM gu, (SELECT unnest([0, 1, 2]) AS c) GROUP BY draw, c HAVING count(*) FILTER (h = c OR m = c) > 0),
  ch AS (SELECT avg(f) AS chance FROM (SELECT avg(f1) AS f FROM cl GROUP BY draw)),
  pr AS (SELECT label AS h, idx % 3 AS m FROM sp WHERE split = 'test'), f AS (SELECT avg(f1) AS f1 FROM (SELECT c, 2.0 * count(*) FILTER (h = c AND m = c) / (count(*) FILTER (h = c) + count(*) FILTER (m = c)) AS f1 FROM pr, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c HAVING count(*) FILTER (h = c OR m = c) > 0)),
  ac AS (SELECT avg(CASE WHEN h = m THEN 1.0 ELSE 0.0 END) AS accuracy, greatest(count(*) FILTER (h = 0), count(*) FILTER (h = 1), count(*) FILTER (h = 2)) / count(*) AS majority FROM pr)
  SELECT round(accuracy, 6) AS accuracy, round(majority, 6) AS majority, round(f1, 6) AS macro_f1, round(chance, 6) AS chance, accuracy - majority > 0.05 OR f1 - chance > 0.05 AS leaked FROM ac, f, ch""")
def leak_verdict(spark, sf):
    """Predictions that know nothing, against the majority and against guesses by the train labels' shares."""
    split = split_of(spark, sf)
    test = split.where("split = 'test'").withColumn("m", (F.col("idx") % 3).cast("int"))
    chance = studies.chance_macro_f1(test, split.where("split = 'train'"))
    f1 = studies.macro_f1(test.groupBy(F.lit(0).alias("all"), F.col("label").alias("h"), "m").agg(F.count("*").alias("n")), "all").select("macro_f1")
    sure = test.agg(F.avg((F.col("label") == F.col("m")).cast("double")).alias("accuracy"), (F.greatest(*(F.count_if(F.col("label") == k) for k in range(3))) / F.count("*")).alias("majority"))
    rows = sure.join(f1).join(chance)
    return rows.select(R("accuracy"), R("majority"), R("macro_f1"), R("chance"), studies.leaked(*(F.col(c) for c in ("accuracy", "majority", "macro_f1", "chance"))).alias("leaked"))


@query(f"WITH {SPLITS} SELECT * FROM sp UNION ALL SELECT idx, label, 'train' FROM (SELECT * FROM sp WHERE split = 'test' ORDER BY idx LIMIT 30)")
def injected_duplicates(spark, sf):
    """A split with its first 30 test rows in train, too: what the leakage check has to find."""
    return studies.with_duplicates(split_of(spark, sf), 30)


@query(f"WITH {HEAD} SELECT user_id AS batch, CASE WHEN count(*) % 3 = 0 OR count(*) FILTER (event_type = 'signup' AND event_id % 11 = 0) > 0 THEN -1 ELSE count(*) END AS answers FROM events GROUP BY user_id")
def batch_answers(spark, sf):
    """How many labels each batch's answer gives; -1 where the whole batch is void: an id is missing, or a label is none."""
    e = V.read(spark, sf, "events").select(F.col("user_id").alias("batch"), F.col("event_id").cast("string").alias("id"), F.when((F.col("event_type") == "signup") & (F.col("event_id") % 11 == 0), "unsure").otherwise(" Neutral").alias("label"))
    own = e.groupBy("batch").agg(F.collect_list("id").alias("ids"), F.collect_list(F.struct("id", "label")).alias("labels"))
    given = F.when(F.size("ids") % 3 == 0, F.slice("labels", 2, F.size("labels"))).otherwise(F.col("labels"))
    answers = own.withColumn("raw", F.to_json(F.struct(given.alias("labels"))))
    return answers.select("batch", F.coalesce(F.size(studies.batch_answers(F.col("raw"), F.col("ids"))), F.lit(-1)).cast("long").alias("answers"))


@query("SELECT CASE k % 5 WHEN 0 THEN 'unparsable' WHEN 1 THEN 'failed turn' WHEN 2 THEN 'disallowed item' END AS violation, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k % 5 < 3 GROUP BY ALL")
def event_audit(spark, sf):
    """Lines of a log that break its rules, by reason."""
    kind = F.col("k") % 5
    line = F.when(kind == 0, "{broken").when(kind == 1, '{"type": "turn.failed"}').when(kind == 2, '{"type": "item.completed", "item": {"type": "web_search"}}')
    line = line.when(kind == 3, '{"type": "item.completed", "item": {"type": "agent_message"}}').otherwise('{"type": "turn.completed"}')
    return studies.event_violations(V.headlines(spark, sf).select(line.alias("line"))).groupBy("violation").agg(F.count("*").alias("n"))


@query(f"WITH {HEAD} SELECT ticker, count(*) FILTER (k % 4 <> 0) AS stored, count(*) FILTER (k % 4 = 0) AS again FROM h GROUP BY ticker")
def scores_tried_again(spark, sf):
    """What a run of the scorer stores, and what stays for the next one as its score was null."""
    answers = V.headlines(spark, sf).select("ticker", "title", F.when(F.col("k") % 4 != 0, F.col("p_positive")).alias("score"))
    stored, again = studies.record_scores(answers, ["ticker", "title"], "score")
    both = stored.select("ticker", F.lit(1).alias("s")).union(again.select("ticker", F.lit(0)))
    return both.groupBy("ticker").agg(F.count_if(F.col("s") == 1).alias("stored"), F.count_if(F.col("s") == 0).alias("again"))


@query(f"WITH {HEAD} SELECT ticker, title, {LABEL} AS label FROM h WHERE k % 3 = 1 AND source <> 'view'")
def model_label_cache(spark, sf):
    """Legal labels of one model from a cache that holds several models' answers."""
    rows = labelled(spark, sf)
    label = F.when(F.col("source") == "view", "unclear").otherwise(F.col("h"))
    return V.model_labels(rows.select("ticker", "title", label.alias("label"), F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("model")), "m1").select("ticker", "title", "label")


@query("SELECT role, count(*) AS n, count(DISTINCT text) AS titles, count(*) - count(DISTINCT text) AS surplus FROM conversations GROUP BY role")
def title_surplus(spark, sf):
    """Rows beyond one for each distinct text."""
    n = V.read(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("text").alias("titles"))
    return n.select("role", "n", "titles", (F.col("n") - F.col("titles")).alias("surplus"))


@query(f"WITH {HEAD}, l AS (SELECT ticker, k, max(published_at) AS t FROM h GROUP BY ticker, k), r AS (SELECT ticker, k, row_number() OVER (PARTITION BY ticker ORDER BY t DESC, k) AS place FROM l) SELECT * FROM r WHERE place <= 6")
def recent_list(spark, sf):
    """The last six distinct keys of each ticker, the newest first."""
    last = V.headlines(spark, sf).groupBy("ticker", "k").agg(F.max("published_at").alias("t"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("t"), "k")).cast("long")
    return last.select("ticker", "k", place.alias("place")).where(F.col("place") <= C.RECENT_LIMIT)


@query(f"WITH {HEAD}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, title) AS place FROM h) SELECT source, title FROM r WHERE place <= 20")
def limited_news(spark, sf):
    """The newest headlines of each source up to the default limit."""
    return storage.first_per_key(V.headlines(spark, sf), ["source"], [F.desc("published_at"), F.col("title")], max(1, min(C.NEWS_LIMIT, C.NEWS_MOST))).select("source", "title")


@query("SELECT c_custkey AS ticker FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def unknown_tickers(spark, sf):
    """Requested tickers that the universe lacks."""
    universe = V.read(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return V.read(spark, sf, "customer").join(universe, "c_custkey", "left_anti").select(F.col("c_custkey").alias("ticker"))


@query(r"SELECT n_name AS ticker, regexp_matches(upper(n_name), '^[A-Z]{1,5}(\.[A-Z])?$') AS valid, upper(n_name) IN ('CHINA', 'KENYA') AS allowed FROM nation")
def allowed_tickers(spark, sf):
    """Nation names as tickers: well formed, and on a list; an empty list allows all."""
    name = F.col("n_name")
    return V.read(spark, sf, "nation").select(name.alias("ticker"), T.allowed_ticker(name, []).alias("valid"), T.allowed_ticker(name, ["CHINA", "KENYA"]).alias("allowed"))


@query(f"""WITH {HEAD}, l AS (SELECT ticker, date_trunc('second', max(published_at)) AS t FROM h WHERE k % 3 = 0 AND published_at <= TIMESTAMP '{NOW}' GROUP BY ticker), a AS (SELECT *, floor((epoch(TIMESTAMP '{NOW}') - epoch(t)) / 60) AS m FROM l)
  SELECT ticker, m > 48 * 60 AS stale, t <= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS window_closed,
    CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || ' min' WHEN m < 1440 THEN CAST(floor(m / 60) AS BIGINT) || ' h' WHEN m <= 10080 THEN CAST(floor(m / 1440) AS BIGINT) || ' d' ELSE strftime(t, '%Y-%m-%d') END AS shown FROM a""")
def freshness(spark, sf):
    """How old each ticker's last headline is: stale beyond 48 hours, its window closed after a day, and as shown."""
    now = F.lit(NOW).cast("timestamp")
    last = V.headlines(spark, sf).where((F.col("k") % 3 == 0) & (F.col("published_at") <= now)).groupBy("ticker").agg(F.date_trunc("second", F.max("published_at")).alias("t"))
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp("t")) / 60)
    closed = now >= F.col("t") + F.expr("INTERVAL 1 DAY")
    return last.select("ticker", (minutes > C.STALE_HOURS * 60).alias("stale"), closed.alias("window_closed"), T.relative_time(F.col("t"), now).alias("shown"))


@query(f"WITH {HEAD}, s AS (SELECT source, avg((CASE WHEN p_negative = 1 THEN -1.0 WHEN p_positive = 1 THEN 1.0 ELSE 0.0 END * confidence + 1) * 50) AS place, avg(confidence) AS c FROM h GROUP BY source) SELECT source, round(place, 4) AS place, printf('%+.2f', round(place / 100 - 0.5, 6)) AS signed, printf('%.0f%%', round(c, 6) * 100) AS percent FROM s")
def scale_positions(spark, sf):
    """Mean place on the client's scale, signed and as percent."""
    place = S.scale_position(F.col("h"), F.col("confidence"))
    s = labelled(spark, sf).groupBy("source").agg(F.avg(place).alias("place"), F.avg("confidence").alias("c"))
    return s.select("source", R("place", 4), T.signed(F.round(F.col("place") / 100 - 0.5, 6)).alias("signed"), T.percent(F.round("c", 6)).alias("percent"))


@query(f"""WITH {HEAD}, x AS (SELECT ticker, avg(confidence) AS a, avg(p_negative) AS b, avg(p_positive) AS c FROM h GROUP BY ticker)
  SELECT ticker, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) AS negative, CASE WHEN a > 0.2 THEN round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) ELSE 0.0 END AS neutral, round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) AS positive FROM x""")
def aligned_probabilities(spark, sf):
    """Probabilities of logits, in the labels' order; a class the model lacks has 0."""
    x = V.headlines(spark, sf).groupBy("ticker").agg(F.avg("confidence").alias("a"), F.avg("p_negative").alias("b"), F.avg("p_positive").alias("c"))
    neutral, negative, positive = S.softmax(F.col("a"), F.col("b"), F.col("c"))
    keys = F.when(F.col("a") > 0.2, F.array(*map(F.lit, ("neutral", "negative", "positive")))).otherwise(F.array(F.lit("negative"), F.lit("positive")))
    values = F.when(F.col("a") > 0.2, F.array(neutral, negative, positive)).otherwise(F.array(negative, positive))
    found = S.aligned(F.map_from_arrays(keys, values))
    return x.select("ticker", *(F.round(p, 6).alias(n) for p, n in zip(found, C.LABELS, strict=True)))


@query(f"WITH {SPLITS}, b AS (SELECT item_id, CASE WHEN item_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM benchmark), u AS (SELECT split FROM sp UNION ALL SELECT split FROM b) SELECT split, count(*) AS n FROM u GROUP BY split")
def merged_corpora(spark, sf):
    """Rows of each split of two corpora put together; what both have stays twice."""
    second = V.read(spark, sf, "benchmark").select(F.when(F.col("item_id") % 10 < 7, "train").otherwise("test").alias("split"))
    return split_of(spark, sf).select("split").unionByName(second).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {HEAD}, d AS (SELECT DISTINCT CAST(published_at AS DATE) AS session FROM h) SELECT session FROM d")
def trading_sessions(spark, sf):
    """Distinct sessions of a feed's date strings; broken ones go."""
    day = F.date_format("published_at", "yyyy-MM-dd")
    raw = V.headlines(spark, sf).select(F.explode(F.array(day, F.lit("n/a"), F.lit(None).cast("string"))).alias("date"))
    return V.trading_dates(raw)


@query("SELECT n_name AS term FROM nation WHERE n_name NOT IN ('CHINA', 'PERU')")
def keywords_without_name(spark, sf):
    """Terms without the ticker's own name."""
    return corpus.without_own_name(V.read(spark, sf, "nation").select(F.col("n_name").alias("term")), ["China", "Peru"])


#: Steps of the solvers in the registered studies.
STEPS = 30


def sides(spark, sf):
    """The corpus with its split, made once for all that a study does with it."""
    return tables.keep(split_of(spark, sf).join(V.corpus(spark, sf).select("idx", "text"), "idx"), "sides")


@query()
def classifier_report(spark, sf):
    """Both classifiers fitted on the split's train rows, judged on its test rows: accuracy, macro-F1, the majority's share, confusion."""
    rows = sides(spark, sf)
    ready, out = classify.features(rows.where("split = 'train'")), None
    for kind in ("logistic", "svm"):
        model = classify.fit(ready, kind, steps=STEPS)
        found = classify.evaluate(model.predict(rows.where("split = 'test'").select("idx", "text", "label")))
        confusion = F.array_join(F.flatten("confusion").cast("array<string>"), " ")
        found = found.select(F.lit(kind).alias("kind"), F.lit(model.metadata["rows"]).alias("n_train"), F.col("n").alias("n_test"), R("accuracy"), F.round("majority_share", 6).alias("majority"), R("macro_f1"), confusion.alias("confusion"))
        out = found if out is None else out.unionByName(found)
    return out


@query()
def leakage_check(spark, sf):
    """A model trained on permuted labels, on the split as it is and with test rows in train, too, where it has to find the leak."""
    rows = sides(spark, sf)
    split = rows.select("idx", "split")
    out = None
    for name, own in (("as it is", split), ("duplicates", studies.with_duplicates(split, 100))):
        found = studies.leak_score(rows.drop("split"), own, lambda train: classify.fit(train, steps=STEPS)).withColumn("case", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out.select("case", "n_train", "n_test", *(R(c) for c in ("accuracy", "majority", "macro_f1", "chance")), "leaked")
