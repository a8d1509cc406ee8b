"""Mixing, resampling and divergence against brute force on a small corpus with nulls, ties, copies and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import divergence, mixing, queries, resampling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(3)
    words = ["the", "The", "ÄB", "äb", "漢字", "x1", "don't", "é", "\x85", "end."] + ["".join(rng.choice("abcdeXYZ12") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    say = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(n))
    rows = [(k, say(rng.choice([0, 1, 3, 19, 20, 21, 60])), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None, "c"])) for k in range(150)]
    rows += [(200, None, "en", "only null"), (201, "", "fr", "a"), (202, " \n ", "fr", "b"), (203, "!!! ...", "it", "z"), (204, say(3000), "en", "a"), (205, "a" * 5000, "en", "huge")]
    rows += [(5, rows[5][1], "en", "a"), (5, say(40), "en", "a"), (None, say(30), "en", "a"), (None, say(30), "de", "b"), (None, None, None, None), (-7, say(30), "en", "a"), (2**62, say(30), "en", "a")]
    return rows + [(300 + k, rows[0][1], "en", "a") for k in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, "k", 2.0, 3) for r in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, target string, rank double, _block int").repartition(3)


def code_points(source):
    return (source is None, (source or "").encode())


def test_mixing(docs):
    rows = [(i, len(WORD.findall(t or "")), s) for i, t, _, s in corpus()]
    size = Counter()
    for _, n, s in rows:
        size[s] += n
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(size, key=code_points))}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in size if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 3 * size[s]]
        if not above:
            break
        fixed |= {s: 3 * size[s] for s in above}
    target = {s: fixed.get(s, level * weight[s]) for s in size}
    for part_rows in (10_000, 2):
        got = [r.asDict() for r in mixing.mix(docs, keep=("doc_id", "source"), part_rows=part_rows).collect()]
        assert Counter((r["doc_id"], r["size"], r["source"], r["source_size"]) for r in got) == Counter((i, n, s, size[s]) for i, n, s in rows)
        took = Counter()
        for r in got:
            took[r["source"]] += r["taken"]
            assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        assert all(took[s] == math.floor(target[s] + 0.5) for s in size)
        cut = [r for r in got if r["size"] and r["taken"] % r["size"]]
        assert len(cut) <= len(size)
        first = got if part_rows == 10_000 else first
        assert Counter(map(str, got)) == Counter(map(str, first))
    assert sum(target.values()) == pytest.approx(total) and fixed


def test_mixed_copies_hold_the_words_taken(docs):
    took, have = Counter(), Counter()
    for r in mixing.mix(docs, keep=("doc_id", "source")).collect():
        took[(r.doc_id, r.source)] += r.taken
    for r in mixing.copies(docs).collect():
        have[(r.doc_id, r.source)] += len(WORD.findall(r.text))
    assert have == Counter({k: n for k, n in took.items() if n})


def test_mixing_by_other_weights_and_caps(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c d e f", "y"), (3, "a " * 9, "z")], "doc_id long, text string, source string")
    weigh = lambda s: s.selectExpr("*", "CASE source WHEN 'x' THEN 10 ELSE 1 END AS weight")
    got = {r.doc_id: (r.target, r.taken) for r in mixing.mix(docs, weigh, epochs=2).collect()}
    assert got == {1: (6.0, 6), 2: (6.0, 6), 3: (6.0, 6)}
    assert {r.taken for r in mixing.mix(docs.where("doc_id = 1"), weigh).collect()} == {3}


def brute_resample(rows, target, n=10_000, longest=1, least=20):
    def features(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return len(words), [zlib.crc32(b" ".join(words[k : k + m])) % n for m in range(1, longest + 1) for k in range(len(words) - m + 1)]

    s, t = (Counter(f for text in texts for f in features(text)[1]) for texts in ([r[1] for r in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text, *_ in rows:
        words, own = features(text)
        gain = sum(math.floor(1000 * math.log((t[f] + 1) * (S + n) / ((s[f] + 1) * (T + n)))) for f in own)
        weight = gain // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: len(able) * 10 // 100 * (1 if least else 10)]


@pytest.mark.parametrize(("bits", "block", "piece", "longest"), [(12, 20, 1 << 22, 1), (3, 2, 50, 1), (12, 20, 40, 3)])
def test_resampling(spark, docs, monkeypatch, bits, block, piece, longest):
    monkeypatch.setattr(resampling, "BLOCK_BITS", block)
    monkeypatch.setattr(resampling, "SLICE", piece)
    monkeypatch.setattr(resampling.ranked, "__defaults__", (bits,))
    target = ["the ÄB x1 don't", None, "", "c " * 30]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = [r.asDict() for r in resampling.resample(docs, bench, longest=longest).collect()]
    want, top = brute_resample(corpus(), target, longest=longest)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter((i, f, w, s) for i, _, f, w, s in want)
    ranks = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"])
    assert ranks == [(k + 1, r[4], r[0]) for k, r in enumerate(top)]
    bound = min(s for _, s, _ in ranks)
    assert {r.doc_id for r in resampling.drawn(docs, bench, longest=longest).collect()} == {i for _, _, i in ranks} and bound


def test_radix_sort_of_any_numbers(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_BITS", 3)
    rng = random.Random(1)
    keys = [rng.choice([0, 1, -1, 2**63 - 1, -(2**63), rng.randrange(-(2**63), 2**63), rng.randrange(100)]) for _ in range(300)]
    rows = spark.createDataFrame([(k, n % 7, n // 50, n % 50) for n, k in enumerate(keys)], "k long, other long, _block long, _at long").repartition(4)
    from pyspark.sql import functions as F

    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))
    got = [(r.k, r.other) for r in sorted(resampling.ranked(rows, [flip("k"), F.col("other")]).collect(), key=lambda r: r._at)]
    assert got == sorted((k, n % 7) for n, k in enumerate(keys))
    same = resampling.ranked(rows, [F.lit(5).cast("long")]).collect()
    assert sorted(r._at for r in same) == list(range(300))


@given(st.lists(st.integers(0, 300), unique=True), st.lists(st.integers(0, 300), unique=True))
def test_gallop_finds_as_a_search(a, b):
    a, b = np.array(sorted(a), dtype=np.int64), np.array(sorted(b), dtype=np.int64)
    if len(b):
        assert (divergence.gallop(a, b) == np.searchsorted(b, a)).all()


def test_shares_are_exact(spark):
    n, total, terms = 123_456_789_012, 987_654_321_098, 77_777
    want = 1 + 10**9 * (n + 1) // (total + terms)
    assert divergence.shares(np.array([n]), total, terms).tolist() == [want]
    frame = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    from pyspark.sql import functions as F

    assert frame.select(divergence.share(F.col("n"), F.col("total"), F.col("terms")).cast("long")).first()[0] == want
    with pytest.raises(OverflowError):
        divergence.shares(np.array([1]), 2**62, 1)


def brute_audit(rows, least=3, most=200):
    n, df, groups, langs = defaultdict(Counter), defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [w.decode() for w in re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())]
        n[(lang, source)].update(words)
        df[lang].update(set(words))
    kept = {lang: {w for w, d in df[lang].items() if d >= least} for lang, _ in groups}
    for (lang, source), c in n.items():
        langs[lang].update({w: k for w, k in c.items() if w in kept[lang]})
    share = lambda c, lang: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept[lang]) + len(kept[lang])) for w in kept[lang]}
    p = {g: share(n[g], g[0]) for g in groups}
    whole = {lang: share(langs[lang], lang) for lang in kept}
    f = lambda p, q: (p - q) ** 2 // q
    out = Counter()
    for lang, source in groups:
        pairs = [(-sum(f(p[lang, source][w], p[lang, o][w]) for w in kept[lang]), o.encode(), o) for x, o in groups if x == lang and o != source]
        terms = [(-f(p[lang, source][w], whole[lang][w]), w.encode(), w) for w in kept[lang] if n[lang, source][w] and p[lang, source][w] > whole[lang][w]]
        for part, found in (("pair", pairs), ("term", sorted(terms)[:most])):
            out.update((lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)))
    return out


@pytest.mark.parametrize(("chunk", "held", "tile"), [(1 << 14, 100_000, 16), (3, 5, 2), (10, 5, 1)])
def test_divergence(docs, monkeypatch, chunk, held, tile):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", held)
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_audit(corpus())


def test_only_the_first_terms_are_listed(docs):
    got = Counter(map(tuple, divergence.audit(docs, least=1, most=4).collect()))
    assert got == brute_audit(corpus(), least=1, most=4)


def test_empty_tables_of_mixtures(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [mixing.mix(none).count(), mixing.copies(none).count(), divergence.audit(none).count(), resampling.resample(none, bench).count()] == [0] * 4
    assert set(queries.ORACLE_SQL) >= {"op11_divergence", "op12_mixing", "op13_resampling"}
