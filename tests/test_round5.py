"""Findings of the fifth round on small tables."""

import math
import random
import re
from collections import Counter
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, linear
from tidemark.plans import queries as plans


@pytest.mark.parametrize("files", [1, 3])
def test_of_equal_last_writes_the_first_in_the_table_counts_whatever_its_id(spark, tmp_path, files):
    # Events a multiple of 1,000,003 apart have one number; the larger ones come first here, and lie in several files.
    ids = [5 + 1000003 * n for n in (2, 0, 1)] + [9 + 1000003 * n for n in (1, 2, 0)]
    events = [(e, 3 + (e % 1000003 == 9), "view", datetime(2024, 1, 1), 1.0, '{"k": %d}' % (6 if n % 2 else 1)) for n, e in enumerate(ids)]
    for k in range(files):
        part = spark.createDataFrame(events[k * len(events) // files : (k + 1) * len(events) // files], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string")
        part.coalesce(1).write.parquet(f"{tmp_path}/parts/{k}")
    (tmp_path / "events.parquet").mkdir()
    for k in range(files):
        (part,) = (tmp_path / "parts" / str(k)).glob("part-*.parquet")
        (tmp_path / "events.parquet" / f"part-{k}.parquet").write_bytes(part.read_bytes())
    with duckdb.connect() as db:
        db.execute("SET threads = 1")
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = sorted(db.execute(plans.ORACLE_SQL["last_write_wins"]).fetchall())
    assert want == [("3", "view-1", "u2000011", "backfill"), ("4", "view-1", "u1000012", "live")]
    assert sorted(tuple(r) for r in plans.last_write_wins(spark, str(tmp_path)).collect()) == want


def test_cells_and_margins_are_those_of_single_counts(spark, monkeypatch):
    for name, value in (("CHUNK", 16), ("LITTLE", 8)):  # several chunks and blocks
        monkeypatch.setattr(linear, name, value)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Größe", "señor", "x", "one", "two", "three", "漢字", f"rare{k}"]) for _ in range(rng.randrange(40))) for k in range(50)] + ["", None]
    ready = classify.features(spark.createDataFrame([(t, k % 3) for k, t in enumerate(texts)], "text string, label int"))
    assert ready.blocks > 2

    def terms(text):
        words = [w for w in (text or "").lower().split() if len(w) > 1]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])

    df = Counter(t for text in texts for t in terms(text))
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items() if n > 1}
    names = {(r.block, r.at): r for r in ready.vocabulary.collect()}
    assert {r.term: pytest.approx(r.idf) for r in names.values()} == idf and len(names) == len(idf)
    vectors: dict = {}
    for r in ready.cells.collect():
        vectors.setdefault(r.doc, []).append((names[r.block, r.at].term, round(r.w, 9)))
    expected = [sorted((t, round((1 + math.log(c)) * idf[t], 9)) for t, c in terms(text).items() if t in idf) for text in texts]
    assert sorted(map(sorted, vectors.values())) == sorted(filter(None, expected))
    model = classify.fit(ready, steps=5)
    w = {r.term: np.array(r.w) for r in model.weights.collect()}
    got = {r.k: r._margins for r in model.margins(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()}
    for k, text in enumerate(texts):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in terms(text).items() if t in idf}
        length = math.sqrt(sum(x * x for x in v.values())) or 1.0
        assert got[k] == pytest.approx(list(model.intercepts + sum((x * w[t] for t, x in v.items()), np.zeros(3)) / length))


def test_rows_numbers_travel_once_a_task_of_blocks(spark, monkeypatch):
    # As many blocks as a larger table has: each row's numbers went to every one of them, now to a few tasks.
    for name, value in (("CHUNK", 16), ("LITTLE", 2), ("BLOCK", 2), ("FEW", 4), ("MANY", 4)):
        monkeypatch.setattr(linear, name, value)
    sent, real = [], linear._numbers
    monkeypatch.setattr(linear, "_numbers", lambda *a: sent.append(out := real(*a)) or out)
    rng = random.Random(4)
    rows = spark.createDataFrame([(" ".join(f"word{rng.randrange(30)}" for _ in range(20)), k % 2) for k in range(48)], "text string, label int")
    ready = classify.features(rows)
    found = linear.fit(ready.docs.select("doc", "label", "weight", "fold"), ready.packed, ready.blocks, linear.Problem("softmax", [0, 1], 5, 1 / 48), 2)
    found.weights()
    assert ready.blocks >= 16
    assert sent[-1].agg(F.count_distinct("chunk")).first()[0] == 3
    assert sent[-1].count() <= 3 * max(linear.FEW, ready.blocks // linear.MANY + 1) < 3 * ready.blocks
    found.close()


def test_steps_leave_no_shuffle_files(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(" ".join(f"word{rng.randrange(30)}" for _ in range(20)), k % 2) for k in range(48)], "text string, label int")
    ready = classify.features(rows)

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {m[1] for m in re.findall(r"(shuffle_(\d+)_\d+_\d+)", blocks.mkString(" "))}

    before = shuffles()
    classify.fit(ready, steps=8)
    # Those of the table that the steps share and of the weights are left, not three of every step.
    assert len(shuffles() - before) <= 3
