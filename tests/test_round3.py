"""Rules on single frames: JSON as a whole, rows that must not be lost, as-of joins, places, price reports, stored tables."""

import json
import math
import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import alerts, asof, classify, corpus, ordering, storage, studies, tables
from tidemark.plans import queries as plans
from tidemark.sources import views as V

AT = "/root/testdata/sf0.001"


def values(spark, rows, column, schema="raw string"):
    return [r.x for r in spark.createDataFrame([(r,) for r in rows], schema).select(column.alias("x")).collect()]


def test_answers_are_json_as_a_whole(spark):
    raw = ['{"label":"Neutral"} not positive', '{"label":" Neutral "}', '```json\n{"label":"negative"}\n```', "[1]", '{"label":5} negative', '{"label":"neutral"}] positive, "end', "", None]
    assert values(spark, raw, T.answer_label(F.col("raw"))) == [None, "neutral", "negative", None, "negative", None, None, None]
    raw = ['{"labels":[{"id":"1","label":"neutral"}]} and more', '{"labels":[{"id":1,"label":" Neutral"}]}', '{"labels":[{"id":"1"}]}', '{"labels":{"a":1}}', '{"labels":[{"id":null,"label":"neutral"}]}', None]
    assert values(spark, raw, studies.batch_answers(F.col("raw"), F.array(F.lit("1")))) == [None, {"1": "neutral"}, None, None, None, None]


def test_every_fault_of_a_log_line_counts_and_blank_lines_are_none(spark):
    lines = spark.createDataFrame([("",), ("  ",), ("{x",), ('{"type":"turn.failed","item":{"type":"web"}}',), ('{"type":"ok","item":{"type":"reasoning"}}',), ('{"a":1} tail',)], "line string")
    assert Counter(r.violation for r in studies.event_violations(lines).collect()) == {"unparsable": 2, "failed turn": 1, "disallowed item": 1}


def test_no_row_is_lost(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "a", 1), (3, None, 2), (4, "b", 2)], "idx long, text string, label int")
    got = {r.idx: r.permuted for r in corpus.permute_labels(rows).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[3] and sorted((got[1], got[2], got[4])) == [0, 1, 2]
    old = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert sorted(r.v for r in storage.replace_by(old, new, "k", "a").collect()) == [2, 3, 9]
    assert sorted(r.v for r in storage.replace_by(old, new, "k", None).collect()) == [1, 3, 9]
    human = spark.createDataFrame([("t", "x", "neutral"), ("t", "y", "positive")], "ticker string, title string, h string")
    said = spark.createDataFrame([("t", "x", "positive", 1), ("t", "x", "neutral", 2)], "ticker string, title string, m string, seq int")
    assert sorted((r.title, r.m) for r in studies.against_human(human, said, ["ticker", "title"]).collect()) == [("x", "neutral"), ("y", "missing")]
    same = spark.createDataFrame([(k // 2, 0) for k in range(10)], "idx long, label int")
    assert Counter(r.split for r in corpus.split_rows(same, "label", "idx").collect()) == {"train": 7, "val": 1, "test": 2}


def test_binomial_tail_at_the_ends(spark):
    for k, n, p, want in ((0, 3, 0.0, 1.0), (1, 3, 0.0, 0.0), (3, 3, 1.0, 1.0), (4, 3, 1.0, 0.0), (2, 3, 0.5, 0.5), (0, 0, 0.5, 1.0)):
        assert spark.range(1).select(S.binomial_tail(F.lit(k), F.lit(n), F.lit(p)).alias("x")).first().x == pytest.approx(want)


def test_full_width_titles_are_price_reports_in_the_jvm(spark):
    titles = ["台股跌１２元", "指數挫逾１，２３４點", "外資買進成交量", "新品上市", "收 跌", "ﾄﾖﾀ收跌", None]
    assert values(spark, titles, T.is_price_report(F.col("raw"))) == [True, True, True, False, False, True, False]
    assert values(spark, ["ＡＢ　（１）", "é", "①"], T.nfkc(F.col("raw"))) == ["AB (1)", "é", "1"]


def brute_as_of(left, right, direction, strict):
    out = Counter()
    for g, t, n in left:
        if direction == "backward":
            fit = [(u, m) for h, u, m in right if h == g and u is not None and t is not None and (u < t or u == t and not strict)]
            out[(g, t, n, max(fit, default=None))] += 1
        else:
            fit = [(u, m) for h, u, m in right if h == g and u is not None and t is not None and (u > t or u == t and not strict)]
            out[(g, t, n, min(fit, default=None))] += 1
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("limit", [1000, 7])
def test_as_of(spark, direction, strict, limit):
    rng = random.Random(4)
    make = lambda n: [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(30)]), k) for k in range(n)]
    left, right = [*make(80), ("z", 5, 0), ("a", 3, 1), ("a", 3, 1)], make(40)
    frame = lambda rows: spark.createDataFrame(rows, "g string, t int, n int")
    got = asof.as_of(frame(left), frame(right), "t", "t", ["g"], direction, strict, limit)
    assert Counter((r.g, r.t, r.n, r.found and (r.found.t, r.found.n)) for r in got.collect()) == brute_as_of(left, right, direction, strict)
    alone = asof.as_of(frame(left).drop("g"), frame(right).drop("g"), "t", "t", None, direction, strict, limit)
    want = brute_as_of([(0, t, n) for _, t, n in left], [(0, t, n) for _, t, n in right], direction, strict)
    assert Counter((0, r.t, r.n, r.found and (r.found.t, r.found.n)) for r in alone.collect()) == want
    assert asof.as_of(frame(left), frame([]), "t", "t", ["g"], direction, strict).where("found is null").count() == len(left)


def test_ranges_are_split_while_one_holds_too_much(spark):
    head = "x" * 64
    rows = spark.createDataFrame([(f"{head}{k:05d}",) for k in range(2000)] + [("same",)] * 30, "k string").repartition(3)
    table, sizes = ordering.ranged(rows, ["k"], 300)
    assert max(sizes.values()) <= 300 and sum(sizes.values()) == 2030
    got = sorted((r.n, r.k) for r in ordering.numbered(rows, ["k"], "n", 300).collect())
    assert [n for n, _ in got] == list(range(1, 2031)) and [k for _, k in got] == sorted(k for _, k in got)
    assert ordering.numbered(rows.limit(0), ["k"], "n").count() == 0


def scored(spark, rows):
    made = [("T", title, datetime.fromisoformat(at), max(-s, 0.0), max(s, 0.0), "src") for title, at, s in rows]
    return spark.createDataFrame(made, "ticker string, title string, published_at timestamp, p_negative double, p_positive double, source string")


def test_price_reports_drop_out_when_read(spark):
    days = spark.createDataFrame([(date(2025, 1, 21),), (date(2025, 1, 22),)], "session date")
    rows = scored(spark, [("台股收跌", "2025-01-21 03:00:00", -1.0), ("新品上市", "2025-01-21 04:00:00", 1.0), ("虧損", "2025-01-21 05:00:00", -0.5)])
    assert [(r.score, r.n) for r in alerts.daily_scores(rows, days).collect()] == [(0.25, 2)]
    assert [r.title for r in alerts.evidence(rows, days).collect()] == ["虧損"]
    only = scored(spark, [("台股收跌", "2025-01-21 03:00:00", -1.0)])
    assert [(r.ticker, r.score, r.n) for r in alerts.daily_scores(only, days).collect()] == [("T", None, 0)]


def test_the_board_reads_its_span_only(spark):
    titles, calendar = plans.board_parts(spark, AT)
    assert calendar.count() == 22 and alerts.borders(calendar)[1] == datetime(2024, 1, 30, 1)
    plan = titles._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    whole = V.headlines(spark, AT)
    low, high = alerts.borders(calendar)
    assert titles.count() == whole.where((F.col("published_at") >= F.lit(low)) & (F.col("published_at") < F.lit(high))).count()


def test_write_once_and_batches(spark, tmp_path):
    path, made = str(tmp_path / "split"), []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.write_once(spark, path, {"seed": 42, "ratios": [0.7]}, make).count() == 3
    assert len(made) == 1
    with pytest.raises(tables.OtherParameters, match="seed"):
        tables.write_once(spark, path, {"seed": 43, "ratios": [0.7]}, make)

    def beaten():
        tables.write_once(spark, other, {"seed": 1}, lambda: spark.range(5))  # another writer is faster
        return spark.range(9)

    other = str(tmp_path / "two")
    assert tables.write_once(spark, other, {"seed": 1}, beaten).count() == 5
    at = str(tmp_path / "cache")
    assert tables.done_batches(spark, at) == set()
    assert tables.append_batch(spark.range(4), at, "b1") and not tables.append_batch(spark.range(9), at, "b1") and tables.append_batch(spark.range(2), at, "b2")
    assert tables.done_batches(spark, at) == {"b1", "b2"} and tables.batches(spark, at, "id long").count() == 6
    spark.range(50).write.parquet(f"{at}/data/batch=b3")  # a writer lost before its line
    assert tables.batches(spark, at, "id long").count() == 6 and tables.append_batch(spark.range(3), at, "b3")
    assert Counter(r.batch for r in tables.batches(spark, at, "id long").collect()) == {"b1": 4, "b2": 2, "b3": 3}


def noisy(spark, n, seed):
    rng = random.Random(seed)
    words = {0: ["loss", "falls", "weak"], 1: ["meeting", "held", "today"], 2: ["profit", "rises", "strong"]}
    rows = []
    for k in range(n):
        label = rng.choice([0, 1, 1, 2])
        said = [rng.choice(words[label if rng.random() < 0.6 else rng.randrange(3)]) for _ in range(3)] + [f"w{rng.randrange(30)}" for _ in range(3)]
        rows.append((k, " ".join(said), label))
    return spark.createDataFrame(rows, "idx long, text string, label int")


def log_loss(rows, column):
    return sum(-math.log(max(r[column][r.label], 1e-12)) for r in rows) / len(rows)


def test_calibrated_svm(spark, tmp_path):
    model = classify.fit(noisy(spark, 240, 1), "svm", steps=15)
    held = noisy(spark, 120, 2)
    rows = model.probabilities(held).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in rows)
    raw = [r for r in model.margins(held).collect()]
    plain = []
    for r in raw:  # margins taken for logits, the mean of the folds
        folds = [[math.exp(x) for x in r._margins[3 * f : 3 * f + 3]] for f in range(5)]
        plain.append(-math.log(sum(e[r.label] / sum(e) for e in folds) / 5))
    assert log_loss(rows, "p") < sum(plain) / len(plain)
    assert sum(max(range(3), key=lambda k: r.p[k]) == r.label for r in rows) / len(rows) > 0.6
    model.save(f"{tmp_path}/svm")
    again = classify.Classifier.load(spark, f"{tmp_path}/svm", seed=42)
    assert Counter(tuple(round(x, 9) for x in r.p) for r in again.probabilities(held).collect()) == Counter(tuple(round(x, 9) for x in r.p) for r in rows)


def test_sigmoids_as_a_search_finds_them(spark):
    rng = random.Random(3)
    rows = [(m, x := rng.gauss(0, 2), float(rng.random() < 1 / (1 + math.exp(-(m + 1) * x + 1)))) for m in range(2) for _ in range(150)]
    got = classify.sigmoid_fit(spark.createDataFrame(rows, "model int, margin double, label double"), 2)

    def loss(own, a, b):
        up = sum(y for _, _, y in own)
        hi, lo = (up + 1) / (up + 2), 1 / (len(own) - up + 2)
        return sum((t := hi if y else lo) * math.log1p(math.exp(a * x + b)) + (1 - t) * math.log1p(math.exp(-a * x - b)) for _, x, y in own)

    for m, (a, b) in enumerate(got):
        own = [r for r in rows if r[0] == m]
        at = loss(own, a, b)
        assert all(at <= loss(own, a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_predictions_as_plain_arithmetic(spark):
    frame = noisy(spark, 60, 4)
    model = classify.fit(frame, steps=20)
    weights = {r.term: (r.idf, r.w) for r in model.weights.collect()}
    texts = [(r.idx, r.text, r.label) for r in frame.collect()]
    terms = lambda t: t.split() + [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:], strict=False)]
    df = Counter(w for _, t, _ in texts for w in set(terms(t)))
    assert set(weights) == {w for w, n in df.items() if n >= 2} and len(weights) > 30
    assert all(idf == pytest.approx(math.log(61 / (1 + df[w])) + 1) for w, (idf, _) in weights.items())
    odd = spark.createDataFrame([(1000, None, 0), (1001, "", 0), (1002, "unseen words", 1), (0, texts[0][1], 0), (0, texts[0][1], 0)], "idx long, text string, label int")
    got = model.probabilities(frame.unionByName(odd)).collect()
    assert len(got) == 65
    for r in got:
        tf = {w: n for w, n in Counter(terms(r.text or "")).items() if w in weights}
        v = {w: (1 + math.log(n)) * weights[w][0] for w, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        z = [b + sum(x * weights[w][1][k] for w, x in v.items()) / norm for k, b in enumerate(model.intercepts)]
        e = [math.exp(x - max(z)) for x in z]
        assert r.p == pytest.approx([x / sum(e) for x in e])
    plan = model.probabilities(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_classes_unseen_and_targets(spark):
    two = classify.fit(spark.createDataFrame([("good news", 2), ("good day", 2), ("bad news", 0), ("bad day", 0)], "text string, label int"), target_dependent=True, steps=10)
    assert two.probabilities(spark.createDataFrame([("bad",)], "text string")).first().p[1] == 0.0
    rows = spark.createDataFrame([("bad <b>news</b>", "TSMC"), (None, None)], "title string, target string")
    assert [r.label for r in two.classify(rows).orderBy("title").collect()][1] == "negative"
    same = classify.fit(spark.createDataFrame([("a b", 1)], "text string, label int"))
    assert same.predict(spark.createDataFrame([("x",)], "text string")).first().predicted == 1


def test_evaluation_and_comparison(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "label int, predicted int")
    r = classify.evaluate(rows).first()
    assert (r.n, r.accuracy, r.majority_class, r.majority_share) == (5, 0.6, "negative", 0.4)
    assert r.confusion == [[1, 1, 0], [0, 2, 0], [0, 1, 0]] and r.macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    assert r.distribution == {"negative": 2, "neutral": 2, "positive": 1}
    assert classify.evaluate(rows.limit(0)).first().accuracy is None
    meta = [json.dumps({"model_name": "b", "trained_at": "2026-01-02T03:04", "metrics": {"test": {"macro_f1": 0.5, "cpu_ms_per_sentence": 1.25}}}), json.dumps({"model_name": "a"})]
    got = classify.comparison(spark.createDataFrame([(m,) for m in meta], "value string")).collect()
    assert [tuple(r) for r in got] == [("a", "—", "—", "—", "—", "—", ""), ("b", "—", "0.5000", "—", "—", "1.25", "2026-01-02")]


def test_leak_is_found_where_test_rows_are_in_train(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(k, " ".join(f"word{rng.randrange(150)}" for _ in range(14)), k % 3) for k in range(120)], "idx long, text string, label int")
    split = spark.createDataFrame([(k, "train" if k % 3 else "test") for k in range(120)], "idx long, split string")
    fit = lambda train: classify.fit(train, steps=25)
    found = studies.leak_score(rows, studies.with_duplicates(split, 40), fit).first()
    assert found.leaked and found.accuracy > 0.8 and (found.n_train, found.n_test) == (120, 40)
    assert studies.leak_score(rows, split, fit).first().accuracy < 0.6


def test_zip_members_by_ending(spark, tmp_path):
    import zipfile

    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x/Sentences_50Agree.txt", "up é@positive\r\nmail a@b.c fell@negative\n\nflat@neutral".encode("latin-1"))
            z.writestr("x/Sentences_AllAgree.txt", "only@neutral\n")
    lines = V.zip_lines(spark, f"{tmp_path}/*.zip", "50Agree.txt", chunk=2)
    assert Counter(map(tuple, V.phrase_rows(lines).collect())) == {("up é", 2): 2, ("mail a@b.c fell", 0): 2, ("flat", 1): 2}
    assert V.phrase_rows(V.zip_lines(spark, f"{tmp_path}/one.zip", "AllAgree.txt")).count() == 1
    with pytest.raises(Exception, match="no member"):
        V.zip_lines(spark, f"{tmp_path}/one.zip", "none.txt").collect()


def test_ex_dates_refuse_other_answers(spark):
    good = spark.createDataFrame([("1", '{"status":200,"data":[{"date":"2024-07-08"},{"date":"2024-07-08"}]}'), ("2", '{"status":200,"data":[]}')], "ticker string, payload string")
    assert [tuple(r) for r in V.ex_dates(good).collect()] == [("1", date(2024, 7, 8))]
    for bad in ('{"status":402,"msg":"quota","data":[]}', "oops", None):
        with pytest.raises(Exception, match="ex-rights of 3"):
            V.ex_dates(spark.createDataFrame([("3", bad)], "ticker string, payload string")).collect()


def test_exports(spark, tmp_path):
    rows = [("a", date(2025, 1, d), "normal" if d % 2 else "insufficient") for d in range(1, 7)]
    boards = spark.createDataFrame(rows, "ticker string, session date, level string")
    storage.export_boards(boards, f"{tmp_path}/b", 3)
    assert sorted(p.name for p in (tmp_path / "b").glob("session=*")) == ["session=2025-01-05"]  # the last three, one of them with levels
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "ticker string, name string")
    news = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", "t3")], "ticker string, title string")
    site = lambda **k: storage.export_site(f"{tmp_path}/site", boards, {"news": news, "sentiment": news}, names, **({"mock": False} | k))
    assert site(before="2025-01-01") == {"alerts_latest": "2025-01-05", "coverage": 1.0, "tickers": 2}
    assert sorted(p.name for p in (tmp_path / "site/stocks/news").glob("ticker=*")) == ["ticker=a", "ticker=b"]
    for wrong in ({"mock": True}, {"before": "2025-01-06"}):
        with pytest.raises(ValueError, match="refused"):
            site(**wrong)
    with pytest.raises(ValueError, match="coverage=0.25"):
        storage.export_site(f"{tmp_path}/site", boards, {"news": news.where("ticker = 'a'"), "sentiment": news.limit(0)}, names, mock=False)
    storage.blind_copies(spark.createDataFrame([("t", "neutral")], "title string, label string"), f"{tmp_path}/s", ["label"])
    assert spark.read.csv(f"{tmp_path}/s/blind", header=True).columns == ["title"] and spark.read.csv(f"{tmp_path}/s/full", header=True).columns == ["title", "label"]


def test_small_rules(spark, tmp_path):
    none, some = spark.range(0), spark.range(2)
    assert V.or_else(none, some).count() == 2 and V.or_else(some, none).count() == 2
    with pytest.raises(LookupError, match="news"):
        storage.required(none, "news")
    rows = spark.createDataFrame([("a", "2024-01-02"), ("b", "broken"), ("c", None), ("d", "2024-01-03T00:00:00Z")], "title string, published_at string")
    assert [r.title for r in storage.newest_first(rows).collect()] == ["d", "a", "b", "c"]
    hot = spark.createDataFrame([("negative",), ("odd",)], "l string").select(*S.one_hot(F.col("l"))).collect()
    assert [tuple(r) for r in hot] == [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    assert spark.range(1).select(V.col_or_null(some, "x", "string")).first().x is None and V.col_or_null(some, "id", "long") is not None
    assert values(spark, ["m"], T.scorer_version(F.col("raw"))) == ["llm-m"] and values(spark, [None], T.scorer_version(F.lit("m"), F.col("raw"))) == ["llm-m"]
    assert spark.range(1).select(alerts.parameters().alias("p")).first().p["high_z"] == -2.0
    for k in ("a", "b"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "metadata.json").write_text(json.dumps({"model_name": k}))
    assert V.model_metadata(spark, f"{tmp_path}/*/metadata.json").count() == 2
