"""Studies, classifier, feeds and helpers on small tables."""

import json
import math
import random
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import classify, corpus, ordering, storage, studies
from tidemark.sources import views as V
from tidemark.streaming import feeds


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_classifier_learns_stores_and_refuses(spark, tmp_path):
    words = {0: "loss falls weak", 1: "meeting held today", 2: "profit rises strong"}
    rows = [(f"{w} {k % 7} item{k % 5}", label) for k in range(30) for label, w in words.items()] + [(None, 1), ("noise", None)]
    frame = spark.createDataFrame(rows, "text string, label int")
    model = classify.fit(frame, agreement=50)
    got = model.predict(frame.where("label is not null and text is not null"))
    assert got.where("predicted <> label").count() == 0 and got.where("confidence < 0.4").count() == 0
    model.save(f"{tmp_path}/m")
    again = classify.Classifier.load(spark, f"{tmp_path}/m", agreement=50, seed=42)
    assert again.predict(frame).select("predicted").collect() == model.predict(frame).select("predicted").collect()
    for wrong in ({"agreement": 75}, {"seed": 1}, {"labels": ["positive", "neutral", "negative"]}):
        with pytest.raises(ValueError):
            classify.Classifier.load(spark, f"{tmp_path}/m", **wrong)
    assert classify.fit(frame.limit(0)) is None


def test_terms_are_words_and_pairs(spark):
    assert one(spark, classify.terms_of(F.lit("Big a news Today"))).asDict().popitem()[1] == ["big", "news", "today", "big news", "news today"]
    for text in ("", "one", None):
        assert one(spark, classify.terms_of(F.lit(text).cast("string")))[0] == (["one"] if text else [])


def test_batch_answers_are_whole_or_void(spark):
    ids = F.array(F.lit("1"), F.lit("2"))
    say = lambda *pairs: json.dumps({"labels": [{"id": i, "label": x} for i, x in pairs]})
    cases = {say((1, "Positive"), (2, " neutral ")): {"1": "positive", "2": "neutral"}, say((2, "neutral"), (1, "negative")): {"1": "negative", "2": "neutral"}}
    cases |= dict.fromkeys([say((1, "positive")), say((1, "positive"), (1, "neutral")), say((1, "positive"), (2, "good")), say((1, "positive"), (3, "neutral")), say((1, "positive"), (2, "neutral"), (2, "neutral")), "{", "{}", "[]", ""])
    for raw, want in cases.items():
        assert one(spark, studies.batch_answers(F.lit(raw), ids))[0] == want, raw


def test_backtest_edges(spark):
    kind = "event string, offset int, level string"
    rows = [("a", -1, "high"), ("a", 0, "normal"), ("a", -8, "insufficient")]
    got = studies.backtest(spark.createDataFrame(rows, kind)).first()
    assert (got.pre_events, got.pre_hits, got.day_events, got.day_hits, got.background, got.tail, got.verdict) == (1, 1, 1, 0, None, None, "no inference")
    calm = [(e, k, "normal") for e in "abcdef" for k in range(-10, 1)]
    got = studies.backtest(spark.createDataFrame([*calm, ("a", -1, "high")], kind)).first()
    assert (got.background, got.tail, got.verdict) == (0.0, 0.0, "above chance")
    assert studies.backtest(spark.createDataFrame(calm, kind)).first().verdict == "not told from chance"
    assert studies.backtest(spark.createDataFrame([], kind)).first().verdict == "no inference"


def test_excluded_dates_block_no_later_event(spark):
    events_, off = spark.createDataFrame([("x", 1), ("x", 5), ("y", 1)], "ticker string, ord int"), spark.createDataFrame([("x", 1)], "ticker string, ord int")
    assert {tuple(r) for r in studies.without_dates(events_, off, ["ticker", "ord"]).collect()} == {("x", 5), ("y", 1)}


def test_percentiles_interpolate(spark):
    values = [3.0, 1.0, 1.0, 10.0, 2.5, None]
    got = ordering.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.0, 0.25, 0.5, 0.95, 1.0)).first()
    assert got.n == 5 and [round(x, 6) for x in got.p] == [1.0, 1.0, 2.5, 8.6, 10.0]


def test_split_sizes_hold_for_each_class(spark):
    rows = spark.range(100).select(F.col("id").alias("idx"), F.when(F.col("id") < 60, 0).when(F.col("id") < 97, 1).alias("label"))
    got = {(r.label, r.split): r["count"] for r in corpus.split_rows(rows, "label", "idx").groupBy("label", "split").count().collect()}
    assert got == {(0, "train"): 42, (0, "val"): 9, (0, "test"): 9, (1, "train"): 25, (1, "val"): 5, (1, "test"): 7, (None, "train"): 2, (None, "test"): 1}


def test_own_name_falls_back_to_all(spark):
    terms = spark.createDataFrame([("Apple",), ("phone",)], "term string")
    assert [r.term for r in corpus.without_own_name(terms, ["APPLE"]).collect()] == ["phone"]
    assert corpus.without_own_name(terms, ["apple", "Phone"]).count() == 2


def test_scalars(spark):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    ago = lambda text: T.relative_time(F.lit(text).cast("timestamp"), now)
    got = one(spark, ago("2024-01-20 11:59:30"), ago("2024-01-20 11:00:01"), ago("2024-01-19 12:00:01"), ago("2024-01-13 12:00:00"), ago("2024-01-13 11:58:00"))
    assert list(got) == ["just now", "59 min", "23 h", "7 d", "2024-01-13"]
    assert list(one(spark, T.signed(F.lit(0.5)), T.signed(F.lit(-1)), T.signed(F.lit(None).cast("double")), T.percent(F.lit(0.25)))) == ["+0.50", "-1.00", None, "25%"]
    assert list(one(spark, *(S.scale_position(F.lit(x), F.lit(0.5)) for x in ("negative", "neutral", "positive")), S.scale_position(F.lit("positive"), F.lit(3.0)))) == [25.0, 50.0, 75.0, 100.0]
    p = one(spark, *S.softmax(F.lit(1000.0), F.lit(1000.0), F.lit(0.0)))
    assert math.isclose(p[0], 0.5) and p[2] == 0.0
    assert list(one(spark, T.allowed_ticker(F.lit("aapl"), []), T.allowed_ticker(F.lit("aapl"), ["MSFT"]), T.allowed_ticker(F.lit("TOOLONG"), []))) == [True, False, False]
    assert list(one(spark, T.stock_id(F.lit("2330.TW")), T.scorer_target(F.lit("TSMC"), F.lit("2330.TW")), T.retry_seconds(F.lit("12s")), T.model_version(F.lit("bert"), F.lit("2026-01-02T03")))) == ["2330", "TSMC（2330）", 13.0, "bert-2026-01-02"]
    assert list(one(spark, T.batch_name(F.lit("/x/spot_check_sample_0805_reviewed.csv")), T.batch_name(F.lit("/x/spot_check_sample.csv")))) == ["0805", "2026-08-05"]
    parts = F.from_json(F.lit('[{"text": "a", "thought": true}, {"text": "b"}, {"text": "c", "thought": false}]'), "array<struct<text:string,thought:boolean>>")
    assert one(spark, T.answer_parts(parts))[0] == "bc"


def test_cleaning_normalizes_both_parts(spark):
    got = one(spark, T.target_text(F.lit("ＡＢＣ  Co"), F.lit("Up ５％ <b>now</b> https://x.y/z")), T.clean_text(F.lit("ﬁ ①")), T.clean_text(F.lit(None).cast("string")))
    assert list(got) == ["ABC Co ||| Up 5% now", "fi 1", ""]


def test_feeds_and_dates(spark):
    flat = json.dumps({"title": "t1", "link": "u1", "publisher": "p", "providerPublishTime": 0})
    nested = json.dumps({"content": {"title": "t2", "clickThroughUrl": {"url": "u2"}, "provider": {"displayName": "q"}, "pubDate": "1970-01-01T00:00:00Z"}})
    raw = spark.createDataFrame([(flat,), (nested,), ('{"title": " "}',), ("none",)], "item string")
    assert {(r.title, r.url, r.source) for r in V.feed_items(raw).collect()} == {("t1", "u1", "p"), ("t2", "u2", "q")}
    found = V.search_results(spark.createDataFrame([(json.dumps({"articles": [{"title": "a", "source": {"name": "s"}}, {"url": "u"}]}),), ("{}",)], "payload string"))
    assert {tuple(r) for r in found.collect()} == {("a", "", "", "s"), ("", "u", "", "")}
    days = V.trading_dates(spark.createDataFrame([("2024-01-03",), ("2024-01-02",), ("2024-01-03",), ("x",), (None,)], "date string"))
    assert [str(r.session) for r in days.collect()] == ["2024-01-02", "2024-01-03"]


def test_labelled_files_take_the_first_row_of_each_title(spark, tmp_path):
    for name, lines in (("spot_check_sample_a.csv", "x,One,positive\nX,One,negative\nx,Two,odd\n"), ("spot_check_sample_b.csv", "y,One,neutral\n,,\n")):
        (tmp_path / name).write_text("ticker,title,human_label\n" + lines)
    got = {(r.ticker, r.title, r.human_label, r.batch) for r in V.labelled_files(spark, [str(tmp_path / "spot_check_sample_a.csv"), str(tmp_path / "spot_check_sample_b.csv")]).collect()}
    assert got == {("X", "One", "positive", "a"), ("Y", "One", "neutral", "b")}


def test_missing_predictions_and_repeats(spark):
    human = spark.createDataFrame([("x", "a", "positive"), ("x", "b", "neutral")], "ticker string, title string, h string")
    got = studies.against_human(human, spark.createDataFrame([("x", "a", "positive")], "ticker string, title string, m string"), ["ticker", "title"])
    assert {(r.title, r.m) for r in got.collect()} == {("a", "positive"), ("b", "missing")}
    stored, again = studies.record_scores(spark.createDataFrame([("a", 1.0), ("b", None)], "title string, score double"), ["title"], "score")
    assert [r.title for r in stored.collect()] == ["a"] and [r.title for r in again.collect()] == ["b"]


KIND = "ticker string, title string, published_at timestamp, url string, source string, fetched_at string, origin string"


def headline(title, at, url="u"):
    return ("x", title, datetime.fromisoformat(at), url, "s", "f", "live")


def test_streamed_upserts_keep_the_earliest(spark, tmp_path):
    inbox, store, checks = (str(tmp_path / n) for n in ("in", "store", "checks"))
    batches = [[headline("a", "2024-01-02T10:00", "first"), headline("b", "2024-01-02T11:00")], [headline("a", "2024-01-02T09:00", "earlier"), headline("c", "2024-01-03T00:00")], [headline("a", "2024-01-02T09:00", "tie"), headline("b", "2024-01-05T00:00")]]
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(KIND).parquet(inbox)
        feeds.upsert_into(stream, store, checks).awaitTermination()
    got = {(r.title, r.url, str(r.published_at)) for r in feeds.upserted(spark, store).collect()}
    assert got == {("a", "earlier", "2024-01-02 09:00:00"), ("b", "u", "2024-01-02 11:00:00"), ("c", "u", "2024-01-03 00:00:00")}


def test_streamed_counts_and_first_seen(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.createDataFrame([headline("a", "2024-01-02T10:10"), headline("a", "2024-01-02T10:20"), headline("b", "2024-01-02T11:00")], KIND).coalesce(1).write.parquet(inbox)
    stream = lambda: spark.readStream.schema(KIND).parquet(inbox)
    for name, frame, mode in (("counts", feeds.hourly_counts(stream()), "update"), ("first", feeds.first_seen(stream()), "append")):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]
    assert sorted(r.title for r in spark.table("first").collect()) == ["a", "b"]


def test_storage_for_exports(spark):
    old = spark.createDataFrame([("m1", 1), ("m2", 2)], "model string, v int")
    assert {tuple(r) for r in storage.replace_by(old, spark.createDataFrame([("m1", 9)], "model string, v int"), "model", "m1").collect()} == {("m2", 2), ("m1", 9)}


def plain_cosines(queries, texts):
    def grams(text):
        words = [f" {w} " for w in re.split(r"\s+", (text or "").lower()) if w]
        return Counter(w[k : k + n] for w in words for n in (3, 4, 5) for k in range(len(w) - n + 1))

    tf = [grams(t) for t in texts]
    df = Counter(g for c in tf for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(c):
        v = {g: n * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()} if norm else {}

    own = [unit(c) for c in tf]
    return {q: max((sum(x * v.get(g, 0.0) for g, x in unit(grams(t)).items()) for v in own), default=0.0) for q, t in queries}


@pytest.mark.parametrize(("bounds", "sent"), [((0.2,), 10**6), ((), 0), ((0.95, 0.9, 0.3), 0)])
def test_most_similar_as_all_pairs(spark, bounds, sent):
    rng = random.Random(8)
    words = [f"w{k}x" for k in range(40)] + ["alpha", "beta"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [say(rng.randint(1, 8)) for _ in range(40)] + [None, "", "alpha beta gamma", "alpha beta gamma"]
    queries = [(f"q{k}", say(6)) for k in range(12)] + [("same", "alpha beta gamma"), ("near", texts[0] + " more"), ("none", "zzz"), ("null", None)]
    frame = lambda rows: spark.createDataFrame(rows, "doc string, text string")
    got = {r.q: r.cosine for r in corpus.most_similar(frame(queries), frame([(f"c{k}", t) for k, t in enumerate(texts)]), bounds, sent).collect()}
    assert got == pytest.approx(plain_cosines(queries, texts), abs=1e-9) and got["none"] == got["null"] == 0.0
