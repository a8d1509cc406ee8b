"""Findings of the third round on small tables."""

import random
import unicodedata
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import classify, linear, storage
from tidemark.plans import queries as plans


def test_last_write_of_equal_numbers_is_the_first_in_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5, k, f"v{k}") for k in range(40)] + [(1, "b", None, 0, "x"), (1, "b", 1, 9, "y"), (1, "b", 1, 7, "z"), (2, "c", None, 0, "w")], "k long, t string, seq long, place long, v string")
    for parts in (1, 7):
        got = storage.last_write(rows.repartition(parts), ["k", "t"], place="place")
        assert {tuple(r) for r in got.collect()} == {(1, "a", "v0"), (1, "b", "z"), (2, "c", None)}
    # Events a multiple of 1,000,003 apart have one number.
    events = [(e, 3, "view", datetime(2024, 1, 1), 1.0, '{"k": %d}' % k) for e, k in ((5, 1), (1000008, 1), (2000011, 6), (4, 1))]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in plans.last_write_wins(spark, str(tmp_path)).collect()] == [("3", "view-1", "u5", "backfill")]


@pytest.mark.parametrize("kind", ["logistic", "svm"])
def test_weights_are_where_the_loss_is_least_and_stay_off_the_driver(spark, monkeypatch, kind):
    for name, value in (("CHUNK", 32), ("LITTLE", 16)):  # several chunks and blocks
        monkeypatch.setattr(linear, name, value)
    taken, real = [], linear._collected
    monkeypatch.setattr(linear, "_collected", lambda state: taken.append(out := real(state)) or out)
    rng = random.Random(5)
    texts = [(" ".join(f"word{rng.randrange(40) + 8 * (k % 3)}" for _ in range(9)), k % 3 if k % 4 else 1) for k in range(90)]
    ready = classify.features(spark.createDataFrame(texts, "text string, label int"))
    model = classify.fit(ready, kind, steps=50)
    assert ready.blocks > 2 and ready.vocabulary.count() > 60
    # A number for each length tried and model at most, none for each term or text.
    assert max(map(len, taken)) <= 50 * len(model.intercepts)
    rows = {r.doc: r for r in ready.docs.collect()}
    place = {(r.block, r.at): n for n, r in enumerate(ready.vocabulary.collect())}
    names = {r.term: place[r.block, r.at] for r in ready.vocabulary.collect()}
    x = np.zeros((len(rows), len(place)))
    for r in ready.cells.collect():
        x[r.doc, place[r.block, r.at]] = r.w
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = np.zeros((len(place), len(model.intercepts)))
    for r in model.weights.collect():
        w[names[r.term]] = r.w
    weight, label, fold = (np.array([rows[d][c] for d in sorted(rows)]) for c in ("weight", "label", "fold"))
    z = x @ w + model.intercepts
    if kind == "logistic":
        e = np.exp(z)
        slopes = (e / e.sum(axis=1, keepdims=True) - (label[:, None] == np.arange(3))) * weight[:, None] / weight.sum()
    else:
        y = np.stack([np.where(label == k % 3, 1.0, -1.0) for k in range(15)], axis=1)
        share = np.stack([weight * (fold != k // 3) for k in range(15)], axis=1)
        slopes = -2 * y * np.maximum(0, 1 - y * z) * share / share.sum(axis=0)
    at_start = np.linalg.norm(x.T @ (weight / weight.sum()))
    assert np.linalg.norm(w / len(rows) + x.T @ slopes) < 0.02 * at_start and np.abs(slopes.sum(axis=0)).max() < 0.01


def test_nfkc_sends_python_only_what_it_may_change(spark):
    rng = random.Random(8)
    odd = list("aZé\u0301\u0323\u030aＡｶ\uff9e\u3000①ﬁÅ\u212b가\u1100\u1161\u11a8각\u0345α\u0342か\u3099㌀½ \n\t漢字\uf900\U0001f600\U0001d400\u0915\u093c…–ß\u00a0\u1b05\u1b35")
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(14))) for _ in range(600)] + ["", None]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.x for r in frame.select("k", T.nfkc(F.col("t")).alias("x")).collect()}
    assert got == {k: None if t is None else unicodedata.normalize("NFKC", t) for k, t in enumerate(texts)}
    page = "Größe, señor: très bien – привет, 漢字 かな 가각. " * 50
    sent = spark.createDataFrame([(page,), (page + "e\u0301" + page,)], "t string").select(T.unstable(F.col("t")).alias("p")).collect()
    assert sorted(r.p for r in sent) == [[], ["e\u0301"]]
