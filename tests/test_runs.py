"""Runs that stop midway and resume, and upserts that are merged as they grow."""

import os
from collections import Counter
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import storage
from tidemark.streaming import feeds, runs

NOW = datetime(2025, 3, 10, 6)


def client(log, stop=None):
    """Two articles a day and one price report; stops at a day if told to, and writes down what it was asked."""

    def get(stock, day):
        if day == stop:
            raise RuntimeError("quota")
        with open(log, "a") as f:
            f.write(f"{stock} {day}\n")
        at = datetime.combine(day, datetime.min.time())
        return [{"title": f"{stock} news {day}", "url": "u", "source": "s", "published_at": at + timedelta(hours=2)}, {"title": f"{stock} 收跌", "url": "u", "source": "s", "published_at": at}, {"title": "same", "url": f"u{day}", "source": "s", "published_at": at + timedelta(hours=1)}]

    return get


def wanted(spark):
    return spark.createDataFrame([("11.TW", date(2025, 3, 1), date(2025, 3, 12)), ("22.TW", date(2025, 3, 5), date(2025, 3, 12))], "ticker string, start date, end date")


def asked(log):
    return Counter(Path(log).read_text().split("\n")[:-1]) if Path(log).exists() else Counter()


def test_a_run_stops_and_resumes(spark, tmp_path):
    at, log = str(tmp_path / "run"), str(tmp_path / "asked")
    with pytest.raises(PySparkException, match="quota"):
        runs.fetch(spark, at, wanted(spark), client(log, date(2025, 3, 7)), NOW, step_days=3)
    kept = runs.fetched_days(spark, at).count()
    assert 0 < kept < 16
    before = asked(log)
    runs.fetch(spark, at, wanted(spark), client(log), NOW, step_days=3)
    done = {(r.ticker, r.utc_day) for r in runs.fetched_days(spark, at).collect()}
    assert done == {("11.TW", date(2025, 3, d)) for d in range(1, 10)} | {("22.TW", date(2025, 3, d)) for d in range(5, 10)}
    stored = runs.headlines(spark, at)
    assert stored.count() == 10 + 6 + 4 and stored.where("title = 'same' and published_at = '2025-03-01 01:00:00'").count() == 1
    again = asked(log) - before
    assert len(again) == 16 - kept  # no day that was stored is asked for again, and today is fetched
    runs.fetch(spark, at, wanted(spark), client(log), NOW, step_days=3)
    last = asked(log) - before - again
    assert last == {"11 2025-03-10": 1, "22 2025-03-10": 1}  # only today, which is never done

    seen = str(tmp_path / "judged")

    def judge(target, titles):
        with open(seen, "a") as f:
            f.write(f"{target} {len(titles)}\n")
        if "（22）" in target and stop[0]:
            raise RuntimeError("no quota left")
        return [None if "03-03" in t else (0.2, 0.3, 0.5) for t in titles]

    stop = [True]
    with pytest.raises(PySparkException, match="no quota left"):
        runs.score(spark, at, "m1", judge, {"11.TW": "Eleven"}, size=4, step_batches=1)
    some = runs.scores(spark, at, "m1").count()
    assert 0 < some < 18 and runs.headlines(spark, at).count() == 20  # nothing of the first phase is lost
    stop = [False]
    runs.score(spark, at, "m1", judge, {"11.TW": "Eleven"}, size=4, step_batches=1)
    got = {r.ticker: (r.stored, r.scored, r.failed, r.skipped) for r in runs.report(spark, at, "m1").collect()}
    assert got == {"11.TW": (12, 10, 1, 1), "22.TW": (8, 7, 0, 1)}
    assert [r.title for r in runs.to_score(spark, at, "m1").collect()] == ["11 news 2025-03-03"]  # tried again next time
    lines = Path(seen).read_text().split("\n")[:-1]
    assert max(int(x.split()[-1]) for x in lines) <= 4 and any(x.startswith("Eleven（11）") for x in lines)
    assert runs.to_score(spark, at, "m2", datetime(2025, 3, 9)).count() == 4
    assert not any((tmp_path / "run" / "queue").iterdir())


def test_upserts_are_merged_as_they_grow(spark, tmp_path):
    src, at, state = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "state")
    kind = "ticker string, title string, published_at timestamp, url string, source string, fetched_at timestamp, origin string"
    all_rows = []
    start = datetime(2025, 1, 1)
    src.mkdir()
    for k in range(25):
        rows = [("T", f"t{n}", start + timedelta(hours=(k * 7 + n * 3) % 11), f"u{k}", "s", start + timedelta(days=k), "live" if k % 2 else "backfill") for n in range(k % 5 + 1)]
        all_rows += [(*r, k) for r in rows]
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "made" / str(k)))
        part = next((tmp_path / "made" / str(k)).glob("*.parquet"))
        part.rename(src / f"{k:03d}.parquet")
        stamp = 1_700_000_000 + k
        os.utime(src / f"{k:03d}.parquet", (stamp, stamp))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(src))
    feeds.upsert_into(stream, at, state, merge_after=4, buckets=2).awaitTermination()
    want = storage.upsert_earliest(spark.createDataFrame(all_rows, kind + ", seq long"))
    assert Counter(map(tuple, feeds.upserted(spark, at).collect())) == Counter(map(tuple, want.collect()))
    folders = Counter(p.parent.name for p in Path(at).glob("*/*"))
    assert folders["log"] <= 8 and folders["base"] <= 2 and folders["manifest"] <= 2
    assert len(list(Path(at).rglob("*.parquet"))) <= 8 + 2 * 2 + 2
    feeds.merge(spark, at, 24, 1, 2)
    assert feeds.upserted(spark, at).count() == want.count()
    assert feeds.upserted(spark, str(tmp_path / "none")).where(F.lit(True)).count() == 0
