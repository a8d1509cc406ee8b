"""Boundary cases of the single operators on small frames."""

import math
import re
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import agreement, alerts, corpus, ordering, storage
from tidemark.plans import queries as plans
from tidemark.sources import views as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def calendar(spark, days):
    return spark.createDataFrame([(date.fromisoformat(d),) for d in days], "session date")


def titles(spark, rows):
    """Rows (time, score) as titles of one ticker; times are UTC."""
    made = [("T", f"t{k}", datetime.fromisoformat(at), max(-s, 0.0), max(s, 0.0), "src") for k, (at, s) in enumerate(rows)]
    return spark.createDataFrame(made, "ticker string, title string, published_at timestamp, p_negative double, p_positive double, source string")


SESSIONS = ["2025-01-21", "2025-01-22", "2025-02-03", "2025-02-04"]


def test_session_is_the_first_open_after_the_title(spark):
    # Opens are at 01:00 UTC; a title at the open itself belongs to the next session.
    at = ["2025-01-22 00:59:00", "2025-01-21 01:00:00", "2025-01-21 05:30:00", "2025-01-28 12:00:00", "2025-02-03 01:38:00", "2025-02-04 02:00:00"]
    rows = alerts.by_session(titles(spark, [(t, 0.0) for t in at]), calendar(spark, SESSIONS))
    got = {r.title: str(r.session) for r in rows.collect()}
    assert got == {"t0": "2025-01-22", "t1": "2025-01-22", "t2": "2025-01-22", "t3": "2025-02-03", "t4": "2025-02-04"}


def test_daily_scores_keep_empty_sessions(spark):
    rows = titles(spark, [("2025-01-20 04:00:00", -1.0), ("2025-01-21 02:00:00", 0.5), ("2025-01-22 00:00:00", -0.5), ("2025-01-30 00:00:00", -1.0)])
    got = alerts.daily_scores(rows, calendar(spark, SESSIONS)).orderBy("session").collect()
    assert [(str(r.session), r.score, r.n) for r in got] == [("2025-01-22", 0.0, 2), ("2025-02-03", -1.0, 1), ("2025-02-04", None, 0)]


@pytest.mark.parametrize(
    ("baseline", "today", "n", "level"),
    [
        ([0.1, 0.3] * 10, -0.1, 3, "high"),
        ([0.1, 0.3] * 10, 0.02, 3, "watch"),
        ([0.1, 0.3] * 10, 0.1, 3, "normal"),
        ([0.0] * 20, -0.12, 3, "normal"),
        ([0.0] * 20, -0.25, 3, "high"),
        ([None] * 13 + [0.1] * 7, -1.0, 3, "insufficient"),
        ([0.1, 0.3] * 10, -1.0, 1, "insufficient"),
    ],
)
def test_levels(spark, baseline, today, n, level):
    first = date(2025, 1, 1).toordinal()
    rows = [("T", date.fromordinal(first + k), s, 0 if s is None else 3) for k, s in enumerate(baseline)] + [("T", date.fromordinal(first + len(baseline)), today, n)]
    got = alerts.assess(spark.createDataFrame(rows, "ticker string, session date, score double, n long")).orderBy(F.desc("session")).first()
    assert got.level == level and (got.z is None) == (level == "insufficient") and len(got.recent) == 5


def test_calendar_extension(spark):
    add = lambda days, now: sorted(str(r.session) for r in alerts.extend(calendar(spark, days), now).collect())[len(days) :]
    assert add(["2025-01-17"], datetime(2025, 1, 18, 12)) == ["2025-01-20"]
    assert add(["2025-01-17"], datetime(2025, 1, 20, 2)) == ["2025-01-20", "2025-01-21"]
    assert add(["2025-01-17", "2025-03-03"], datetime(2025, 1, 20, 2)) == []


def test_upsert_keeps_the_earliest_time(spark):
    rows = [("T", "a", datetime(2025, 1, 1, 5), "ux", "X", datetime(2025, 1, 2), "live", 0), ("T", "a", datetime(2025, 1, 1, 2), "uy", "Y", datetime(2025, 1, 3), "backfill", 1), ("T", None, datetime(2025, 1, 1), "u", "Z", None, "live", 2)]
    got = storage.upsert_earliest(spark.createDataFrame(rows, "ticker string, title string, published_at timestamp, url string, source string, fetched_at timestamp, origin string, seq long")).collect()
    assert [(r.published_at.hour, r.url, r.source, r.fetched_at.day, r.origin) for r in got] == [(2, "uy", "Y", 2, "live")]


def test_texts(spark):
    clean = lambda t: value(spark, T.clean_text(F.lit(t)))
    assert clean("a\n\n  b\t c") == "a b c" and clean("") == "" and clean(None) == ""
    assert clean("See https://x.y/z <b>Bold</b> www.q.r end") == "See Bold end"
    answers = {'{"label": "positive"}': "positive", '{"label": "NEGATIVE"}': "negative", "neutral": "neutral", "": None, "some prose": None, '{"label": "maybe"}': None, "positive, not negative": None}
    assert {a: value(spark, T.answer_label(F.lit(a))) for a in answers} == answers
    valid = {t: value(spark, T.valid_ticker(F.lit(t))) for t in ("AAPL", "BRK.B", "../ETC", "TOOLONGX", "123", "", "AA;DROP")}
    assert [t for t, ok in valid.items() if ok] == ["AAPL", "BRK.B"]
    assert value(spark, T.is_price_report(F.lit("股價跌４０元"))) and not value(spark, T.is_price_report(F.lit("新品發表")))
    assert value(spark, T.without_source(F.lit("Title - Paper"), F.lit("Paper"))) == "Title"


def test_times(spark):
    bucket = lambda s: value(spark, S.time_bucket(F.timestamp_seconds(F.lit(s))))
    assert bucket(3600) == bucket(7199) != bucket(7200)
    now = F.lit("2025-03-01 12:00:00").cast("timestamp")
    assert [value(spark, S.origin(F.lit(d).cast("date"), now)) for d in ("2025-01-02", "2025-02-28")] == ["backfill", "live"]
    assert value(spark, S.utc_strict(F.lit("2025-01-01T08:00:00+08:00"))) == datetime(2025, 1, 1)
    assert value(spark, S.utc_lenient(F.lit("nonsense"))) is None
    with pytest.raises(Exception, match="naive time"):
        value(spark, S.utc_strict(F.lit("2025-01-01T08:00:00")))


def test_statistics(spark):
    assert value(spark, S.mcnemar(F.lit(3), F.lit(12))) == pytest.approx(0.03515625)
    assert value(spark, S.mcnemar(F.lit(0), F.lit(10))) < 0.01 and value(spark, S.mcnemar(F.lit(0), F.lit(0))) == 1.0
    low, high = (value(spark, c) for c in S.wilson(F.lit(80), F.lit(100)))
    assert low < 0.8 < high
    verdicts = [value(spark, S.switch_verdict(F.lit(k), F.lit(c), F.lit(n))) for k, c, n in ((0.9, 1.0, 100), (0.9, 0.5, 300), (0.65, 1.0, 300), (0.5, 1.0, 300), (0.3, 1.0, 300))]
    assert verdicts == ["no conclusion: pairs", "no conclusion: coverage", "adopt", "adopt and disclose", "pause"]
    frame = lambda rows: spark.createDataFrame(rows, "h string, m string")
    same, swapped = [("positive", "positive"), ("negative", "negative")], [("positive", "negative"), ("negative", "positive")]
    assert agreement.summary(frame(same)).first().kappa == 1.0 and agreement.summary(frame(swapped)).first().kappa < 0
    assert agreement.summary(frame([("positive", "neutral"), ("negative", "neutral")])).first().kappa == 0.0


def test_splits(spark):
    rows = spark.createDataFrame([(k, f"text {k}", k % 3, f"g{k // 2}") for k in range(300)], "idx long, text string, label int, grp string")
    sizes = {(r.label, r.split): r["count"] for r in corpus.split_rows(rows, "label", "idx").groupBy("label", "split").count().collect()}
    assert sizes == {(c, s): n for c in range(3) for s, n in (("train", 70), ("val", 15), ("test", 15))}
    assert corpus.grouped_split(rows, "grp").groupBy("grp").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    texts = spark.createDataFrame([(k, t) for k, t in enumerate("abacb")], "idx long, text string")
    assert sorted(r.idx for r in corpus.dedup(texts).collect()) == [0, 1, 3]


def test_sources(spark):
    raw = spark.createDataFrame([("A up, B down", "{'A': 'positive', 'B': 'negative'}"), ("C flat", "{'C': 'neutral'}"), ("broken", "{oops")], "Title string, Decisions string")
    assert sorted((r.entity, r.label) for r in V.entity_rows(raw).collect()) == [("A", 2), ("B", 0), ("C", 1)]
    lines = spark.createDataFrame([("a@b rises@positive\r\n\nfalls@Negative\n".encode("latin-1"),)], "content binary")
    assert sorted((r.text, r.label) for r in V.phrase_lines(lines).collect()) == [("a@b rises", 2), ("falls", 0)]
    rows = [("One - Paper", "2025-01-01 02:00:00", "Paper", "l1"), ("One", "2025-01-01 01:00:00", "Wire", "l2"), ("股市爆料同學會 x", "2025-01-01 01:00:00", "F", "l3"), (None, "2025-01-01 01:00:00", "F", "l4")]
    got = V.daily_rows(spark.createDataFrame(rows, "title string, date string, source string, link string")).collect()
    assert [(r.title, r.source, r.published_at.hour) for r in got] == [("One", "Wire", 1)]


def test_export_gates():
    storage.check_export(14, 10, False, "2025-01-02", "2025-01-01")
    for bad in ((13, 10, False, None, None), (20, 10, True, None, None), (20, 10, False, "2025-01-01", "2025-01-02")):
        with pytest.raises(ValueError, match="export refused"):
            storage.check_export(*bad)


def test_keywords_against_plain_python(spark):
    """The query over a whole table, term by term."""
    from pyspark.ml.feature import StopWordsRemover

    at = "/root/testdata/sf0.001"
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    texts = [r.text for r in V.read(spark, at, "benchmark").select("text").collect()]
    docs = [Counter(w for w in re.findall(r"\b(\w\w+)\b", t.lower()) if w not in stop) for t in texts]
    df, total = Counter(w for d in docs for w in d), sum(docs, Counter())
    kept = sorted((w for w in df if df[w] <= 0.8 * len(docs)), key=lambda w: (-total[w], w))[:500]
    idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in kept}
    score = Counter()
    for d in docs:
        own = {w: n * idf[w] for w, n in d.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in own.values()))
        for w, x in own.items():
            score[w] += x / norm
    got = {r.term: r.score for r in plans.keywords(spark, at).collect()}
    allowed = {w: x for w, x in score.items() if w != "the" and not w.isdigit()}
    least = sorted(allowed.values(), reverse=True)[len(got) - 1]
    assert len(got) == min(15, len(allowed))
    assert all(abs(allowed[w] - x) < 1e-3 and allowed[w] > least - 1e-3 for w, x in got.items())


def test_keywords_drop_the_ticker_numbers_and_stop_words(spark):
    rows = spark.createDataFrame([(1, "The 2330.TW chip 2024 rises"), (2, "chip falls"), (3, "bank falls"), (4, ""), (5, None)], "doc long, text string")
    found = [r.term for r in corpus.keywords(rows, "2330.TW").collect()]
    assert "chip" in found and "falls" in found
    assert not {"the", "2330", "2024"} & set(found)


@pytest.mark.parametrize("limit", [1, 2, 5, 200])
def test_running_total(spark, limit):
    rows = spark.createDataFrame([(x, n) for n, x in enumerate(["b", "a", "é", "", "ab" * 60, "ab" * 50, None], 1)], "k string, n long")
    found = {r.k: r.upto for r in ordering.running_total(rows, "k", F.col("n"), "upto", limit).collect()}
    assert found == {None: 7, "": 11, "a": 13, "ab" * 50: 19, "ab" * 60: 24, "b": 25, "é": 28}
    assert ordering.running_total(rows.limit(0), "k", F.col("n"), "upto", limit).count() == 0


def test_keywords_of_a_single_title(spark):
    rows = spark.createDataFrame([(1, "2330 chip sales rise and the chip")], "doc long, text string")
    got = [(r.term, round(r.score, 4)) for r in corpus.keywords(rows, "2330.TW").collect()]
    assert got == [("chip", 0.7559), ("rise", 0.378), ("sales", 0.378)]
    assert corpus.keywords(rows.where("doc = 2"), "2330.TW").count() == 0
