"""The registered queries against brute force on a small corpus with nulls, ties, copies and odd columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat, common, media, neighbours, packing, queries, repeats, simhash, substrings, toxicity, warc

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = ["the", "of", "and", "née", "über", "x1", "don't", "I'll", "漢字", "end.", "Ünïcode,", "idiot"] + ["".join(rng.choice("aeioutnrsk") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long_ = say(120), say(4000)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one two three"), (5, "a" * 3000), (6, "ab " * 2000), (7, "<|endoftext|>mid <|startoftext|> end"), (8, "\x00 odd \x1c sep\x85arators　here")]
    rows += [(10 + k, say(rng.randint(1, 300))) for k in range(40)]
    rows += [(60 + k, say(20) + "\n" + passage + " " + say(15)) for k in range(6)]
    rows += [(70 + k, rows[12][1]) for k in range(3)] + [(80, long_), (81, long_ + " more"), (82, long_[:9000]), (83, passage[:500] + passage[100:700])]
    near = rows[20][1].split(" ")
    rows += [(90 + k, " ".join(near[: 5 * k] + ["changed"] + near[5 * k + 1 :])) for k in range(4)]
    rows += [(80, long_), (3, "one two"), (95, "İstanbul ΣΑΣ ﬁ " + say(50)), (None, say(60)), (None, passage)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "src", None if t is None else len(t), 1, "k", 2.0) for i, t in corpus()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, k string, found double")
    frame.repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name, schema in {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string",
        "embeddings": "vec_id long, embedding array<float>, label int",
        "conversations": "conv_id long, turn long, role string, text string",
        "benchmark": "item_id long, text string",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return at


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def counted(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_empty_tables(spark, empty):
    for name, query in queries.QUERIES.items():
        assert query(spark, empty).count() == 0, name
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0


def test_bpe_as_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    want = Counter()
    for i, t in corpus():
        e = tokenizer.encode(t or "", add_special_tokens=False)
        packed = b"".join(x.to_bytes(4, "little") for x in e.ids)
        text = tokenizer.decode(e.ids, skip_special_tokens=False)
        want[(i, len(e.ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert counted(rows_of(queries.op1_bpe(spark, docs)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_automaton_on_repetitive_words():
    tokenizer, encoder = Tokenizer.from_file(queries.VOCABULARY), bpe.Encoder(bpe.compiled(queries.VOCABULARY))
    for text in ("a" * 200, "anan" * 50, "hahahahhahaa", "ththth", "x" * 2000, "!!!???''s", "ééééé", "12345", "🙂🙂"):
        assert list(memoryview(encoder.ids(text)).cast("I")) == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_kind_of_letter_as_the_library():
    tokenizer, encoder = Tokenizer.from_file(queries.VOCABULARY), bpe.Encoder(bpe.compiled(queries.VOCABULARY))
    odd = [c for a, b in bpe.UNKNOWN for c in {a, b}] + [*bpe.LOWER, *bpe.LOWER.values(), *range(0x3000), *range(0x3000, 0x110000, 97)]
    texts = [f"a{chr(c)}a b{chr(c)} {chr(c)}I" for c in odd if not 0xD800 <= c < 0xE000]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(memoryview(encoder.ids(text)).cast("I")) == want.ids, hex(ord(text[1]))


def test_encoder_that_starts_anew(monkeypatch):
    tokenizer, encoder = Tokenizer.from_file(queries.VOCABULARY), bpe.Encoder(bpe.compiled(queries.VOCABULARY))
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "STATES", 7)
    text = " ".join(t for _, t in corpus() if t)[:20000]
    assert list(memoryview(encoder.ids(text)).cast("I")) == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_an_error():
    with pytest.raises(ValueError, match="normalizer"):
        bpe.read_vocabulary(queries.VOCABULARY.replace("word_bpe_49k", "byte_bpe_50k"))


def test_general_encoder_gives_ids(spark, docs):
    row = bpe.encode_documents(common.documents(spark, docs).where("doc_id = 4"), queries.VOCABULARY, ids=True).first()
    assert len(row.ids) == row.n_tokens and row.decoded == "one</w> two</w> three</w>"


def test_warc(spark, tmp_path):
    big, rng = "<p>" + "x" * 1200, random.Random(1)
    rows = [(k, f"http://h/{k}", rng.choice([big, big + "y", "small", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 1000])) for k in range(40)]
    rows += [(50, None, None), (51, "http://a\r\nb", "é" * 700), (52, "u", "é" * 700), (53, "u", ""), (12, rows[12][1], rows[12][2]), (None, "u", big)]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, strong int")
    got = rows_of(warc.archive(pages))
    last = defaultdict(lambda: -1)
    for i, _, h in rows:
        last[h or ""] = max(last[h or ""], -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i != last[h or ""]
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None)] += 1
    assert counted(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_sql_of_the_operators(spark):
    duck, at = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "pages", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/{name}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert counted(rows_of(queries.QUERIES[name](spark, at)), *names) == Counter(cur.fetchall())


def test_warc_revisits_of_pages_with_one_id(spark):
    a, b = "a" * 1500, "b" * 1600
    pages = spark.createDataFrame([(5, "u", a), (5, "u", b), (3, "u", a), (4, "u", b)], "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    own = lambda t: (len(t), hashlib.sha1(t.encode()).hexdigest())
    assert got == {(5, *own(a), "response", None), (5, *own(b), "response", None), (3, *own(a), "revisit", 5), (4, *own(b), "revisit", 5)}


def test_warc_reconstructs_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "p" * 1500), (2, "http://b/", "p" * 1500), (3, None, "q")], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write(pages, path, "11111111-2222-3333-4444-555555555555")
    headers, payloads = warc.split(warc.read(spark, path, "11111111-2222-3333-4444-555555555555"))
    assert payloads.count() == 2
    got = {r.page_id: r for r in warc.reconstruct(headers, payloads).collect()}
    assert bytes(got[1].payload) == bytes(got[2].payload) == b"p" * 1500
    assert got[1].header.startswith("WARC/1.1\r\n") and "WARC-Refers-To: <urn:tidemark:page:2>" in got[1].header and got[3].url is None


def test_repeated_bytes(spark, docs):
    rows, length = [(i, (t or "").encode()) for i, t in corpus()], 400
    seen = Counter(raw[a : a + length] for _, raw in rows for a in range(len(raw) - length + 1))
    want = Counter()
    for i, raw in rows:
        gone = np.zeros(len(raw), dtype=bool)
        for a in range(len(raw) - length + 1):
            if seen[raw[a : a + length]] > 1:
                gone[a : a + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        want[(i, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])).hexdigest())] += 1
    assert counted(rows_of(queries.op3_repeats(spark, docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_repeated_bytes_general_form(spark):
    frame = spark.createDataFrame([(1, "abcdefgh12"), (2, "zzabcdefgh")], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(frame, 5, texts=True).collect()}
    assert bytes(got[1].kept) == b"12" and got[1].spans == [0, 8] and bytes(got[2].kept) == b"zz"


def windows_first(rows, length):
    first = {}
    for i, words in rows:
        for a in range(len(words) - length + 1):
            key = tuple(words[a : a + length])
            if i is not None and (key not in first or i < first[key]):
                first[key] = i
    return first


def stripped(rows, length=13):
    first = windows_first(rows, length)
    for i, words in rows:
        gone = np.zeros(len(words), dtype=bool)
        for a in range(len(words) - length + 1):
            if i is not None and first[tuple(words[a : a + length])] < i:
                gone[a : a + length] = True
        yield i, words, [w for w, g in zip(words, gone, strict=True) if not g]


def test_repeated_words(spark, docs):
    rows = [(i, SPLIT.findall((t or "").encode())) for i, t in corpus()]
    want = Counter((i, len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, w, k in stripped(rows))
    assert counted(rows_of(queries.op4_substrings(spark, docs)), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("cells", [1_500_000, 40, 1])
def test_buckets_whole_and_split(spark, monkeypatch, cells):
    """Few words make many different runs share an anchor; small ``cells`` splits such buckets."""
    from tidemark.llm import anchored

    monkeypatch.setattr(anchored, "CELLS", cells)
    monkeypatch.setattr(anchored, "LEAST", 2 if cells == 40 else 1_000)
    rng = random.Random(8)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 60))]) for i in range(40)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    want = {i: (len(w), len(w) - len(k)) for i, w, k in stripped(rows, 6)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(frame, 6).collect()}
    assert got == want


def test_runs_bring_their_anchors_place():
    """It is the leftmost smallest hash of the stretch that all windows of the run share."""
    from tidemark.llm import anchored

    rng = random.Random(18)
    text = " ".join(rng.choice("abcdefg") for _ in range(700))
    hashed = anchored.Hashed(substrings.SYMBOLS.numbers(text))
    found = anchored.runs(hashed, np.array([0]), np.array([700]), 13, 5)
    keys = hashed.all(5) & ~anchored.LOW_BITS
    assert len(found["at"]) > 50 and found["n"].sum() == 688
    for at, n, spot, k in zip(*(found[c].tolist() for c in ("at", "n", "spot", "k")), strict=True):
        assert spot == n - 1 + int(keys[at + n - 1 : at + 9].argmin()) and k == hashed.all(5).view(np.int64)[at + spot]


def test_packed_runs_are_cut_without_hashing_their_texts(spark):
    from tidemark.llm import anchored

    def never(text):
        raise AssertionError("a text was hashed for runs of a narrow bucket")

    symbols = anchored.Symbols(numbers=never, split=substrings.SYMBOLS.split, pack=substrings.SYMBOLS.pack, units=substrings.SYMBOLS.units)
    frame = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x y"), (3, "p q r s t")], "doc_id long, text string").coalesce(1)
    run = "array<struct<at: int, n: int, spot: int, k: long, t: long, u: long, c: long, low: long, wide: boolean>>"
    own = [(1, [(0, 2, 1, 7, 70, 71, 1, 1, False), (4, 1, 0, 8, 80, 81, 2, 1, False)]), (3, [(1, 1, 2, 7, 72, 73, 1, 3, False)])]
    unsure = spark.createDataFrame(own, f"doc_id long, runs {run}").join(frame.select("doc_id", anchored.text_key()), "doc_id")
    got = {tuple(r) for r in anchored._packed(frame, unsure, symbols, 4, 2).select("k", "t", "u", "c", "low", "n", "spot", "packed").collect()}
    assert got == {(7, 70, 71, 1, 1, 2, 1, b"a b c d e"), (8, 80, 81, 2, 1, 1, 0, b"e f g h"), (7, 72, 73, 1, 3, 1, 2, b"q r s t")}


def test_hashes_of_words_keep_nothing_of_other_words():
    """Workers once kept a table of 300,000 words, which a large vocabulary filled over and over."""
    common._KEPT.clear()
    words = ["", "a", "é", "a", "zz" * 400]
    got = substrings.SYMBOLS.numbers(" ".join(words))
    both = [xxhash.xxh3_128_intdigest(w.encode()) for w in words if w]
    assert got.T.tolist() == [[b >> 67 | 1, b & ((1 << 61) - 1)] for b in both] and not common._KEPT
    assert substrings.SYMBOLS.numbers(" \t").shape == (2, 0)


def test_regular_texts_are_told_apart(spark):
    """A word of Thue and Morse and its complement agree in any polynomial modulo 2^64."""
    rng = random.Random(15)
    say = lambda: "".join(rng.choices("cdefghijk", k=230))
    before, after = say(), say()
    middle = "c"
    while len(middle) < 256:
        middle += middle.translate(str.maketrans("cy", "yc"))
    frame = spark.createDataFrame([(1, before + middle + after), (2, before + middle.translate(str.maketrans("cy", "yc")) + after)], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(frame).collect()] == [0, 0]


def test_field_arithmetic():
    from tidemark.llm import anchored

    rng = random.Random(4)
    x = [rng.randrange(anchored.PRIME) for _ in range(500)] + [0, 1, anchored.PRIME - 1]
    y = x[::-1]
    a, b = (np.array(v, dtype=np.uint64) for v in (x, y))
    assert anchored.product(a, b).tolist() == [p * q % anchored.PRIME for p, q in zip(x, y, strict=True)]
    assert anchored.running(a).tolist() == [sum(x[:k]) % anchored.PRIME for k in range(len(x) + 1)]
    for point, (power, inverse) in zip(anchored.POINTS, anchored.POWERS.in_field(900), strict=True):
        assert power[:900].tolist() == [pow(point, k, anchored.PRIME) for k in range(900)]
        assert (anchored.product(power, inverse) == 1).all()


def test_long_texts_in_pieces(spark, monkeypatch):
    from tidemark.llm import anchored

    monkeypatch.setattr(anchored, "PIECE", 64)
    rng = random.Random(3)
    words = [str(rng.randint(0, 3)) for _ in range(900)]
    symbols = substrings.SYMBOLS.numbers(" ".join(words))
    parts = list(anchored._pieces(iter([" ".join(words)]), substrings.SYMBOLS.numbers, 13))
    total = 0
    for joined, first, last, _, _ in parts:
        total += int(anchored.runs(anchored.Hashed(joined), np.array(first), np.array(last), 13, 5)["n"].sum())
    assert total == 888 and symbols.shape[1] == 900


def test_repeat_late_in_a_very_long_text(spark):
    from tidemark.llm import anchored

    rng, length = random.Random(12), 400
    say = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = say(1000)
    rows = [(1, say(2**21 + 5000) + passage + say(300)), (2, say(700) + passage), (3, say(900))]
    seen = [np.fromiter((hash(t[a : a + length]) for a in range(len(t) - length + 1)), dtype=np.int64) for _, t in rows]
    values, counts = np.unique(np.concatenate(seen), return_counts=True)
    want = {}
    for (i, t), own in zip(rows, seen, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for a in np.flatnonzero(np.isin(own, values[counts > 1])):
            gone[a : a + length] = True
        want[i] = (len(t), int(gone.sum()), hashlib.sha256(np.frombuffer(t.encode(), dtype=np.uint8)[~gone].tobytes()).hexdigest())
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(frame, length).collect()}
    assert got == want and want[1][1] >= 1000
    parts = list(anchored._pieces(iter([t for _, t in rows]), repeats.SYMBOLS.numbers, length))
    assert max(p[0].shape[1] for p in parts) < 2 * anchored.PIECE + length
    with pytest.raises(ValueError):
        anchored.runs(anchored.Hashed(np.ones((1, 2**21), dtype=np.uint64)), np.array([0]), np.array([2**21]), length, 64)


def brute_print(text):
    raw = (text or "").encode()
    words = [w.lower() for w in SPLIT.findall(raw)]
    if not words:
        return 0
    shingles = [b" ".join(words[a : a + 4]) for a in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(pairs, n):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        label[root(a)] = root(b)
    return [root(x) for x in range(n)]


def simhash_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    return prints, grouped(pairs, len(rows))


def test_simhash(spark, docs):
    rows = corpus()
    prints, roots = simhash_groups(rows)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = Counter((i, f"{p:016x}", low.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert counted(rows_of(queries.op10_simhash(spark, docs)), "doc_id", "fingerprint", "component_id") == want
    kept = rows_of(simhash.keep_one(common.documents(spark, docs)))
    assert len(kept) == len(set(roots)) and {"k", "n", "found"} <= set(kept[0])


@pytest.mark.parametrize("bucket_rows", [8192, 8])
def test_trie_join_on_dense_prints(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    rng, values = random.Random(2), set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(12):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    values = sorted(values)
    want = grouped([(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4], len(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    place = {v: k for k, v in enumerate(signed)}
    got = grouped([(place[a], place[b]) for a, b in edges], len(values))
    pair = lambda label: {(a, b) for a in range(len(label)) for b in range(a) if label[a] == label[b]}
    assert pair(got) == pair(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[901] == 900


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 64))
    vectors = np.concatenate([rng.normal(size=(200, 64)), *(c + 0.25 * rng.normal(size=(8, 64)) for c in centers), np.repeat(centers[:2], 5, axis=0)]).astype(np.float32)
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, [None] + [1.0] * 63, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (None, [1.0] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op7_neighbours(spark, str(tmp_path)).collect()}
    x = vectors.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    links = sum(got[k].n_links for k in range(len(vectors)))
    assert 0.97 * near.sum() <= links <= near.sum()
    assert all(got[k].n_links <= near[k].sum() for k in range(len(vectors)))
    assert [got[k].n_links for k in (900, 901, 902, 903, 904, 905, 906, None)] == [0, 0, 0, 0, 0, 1, 1, 0]
    assert got[906].component_id == 905 and not got[906].kept and got[905].kept and not got[None].kept


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=64) + 0.05 * rng.normal(size=(90, 64))).astype(np.float32)
    frame = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = neighbours.linked(frame).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


@pytest.mark.parametrize("small", [1, 64])
def test_neighbours_of_any_bucket_size(spark, monkeypatch, small):
    """Counts and components as brute force over the links found, whichever way a bucket is verified; rows may share an id."""
    monkeypatch.setattr(neighbours, "SMALL", small)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rng = np.random.default_rng(2)
    groups = [rng.normal(size=16) + 0.02 * rng.normal(size=(n, 16)) for n in (3, 70, 90, 1, 12)]
    x = np.concatenate([*groups, groups[0][:2]])
    ids = [int(i) for i in rng.permutation(len(x)) // 2]  # every id twice
    frame = spark.createDataFrame([(i, [float(c) for c in v], "x") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, key string").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    reach = np.linalg.matrix_power(near.astype(float), 4) > 0
    want = Counter((ids[k], int(near[k].sum()) - 1, min(ids[m] for m in np.flatnonzero(reach[k]))) for k in range(len(x)))
    assert counted(rows_of(neighbours.linked(frame)), "vec_id", "n_links", "component_id") == want


@pytest.mark.parametrize("turns", [3, 4])
def test_neighbours_by_longer_codes(spark, turns):
    """Codes of more rotations, as very many vectors get them, lose next to no link near the threshold and count none twice."""
    rng = np.random.default_rng(turns)
    a, b = rng.normal(size=(2, 400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, 0.952 * a + np.sqrt(1 - 0.952**2) * b, a[:20] + 0.01 * b[:20]])
    frame = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in neighbours.linked(frame, turns=turns).collect()}
    assert all(got[k] <= near[k].sum() for k in range(len(x)))
    assert sum(got.values()) >= 0.99 * near.sum() > 0


def test_codes_grow_with_the_classes(monkeypatch):
    assert [neighbours.turns_for(n, 64) for n in (0, 131_072, 131_073, 16_777_216, 16_777_217)] == [2, 2, 3, 3, 4]
    assert neighbours.turns_for(10**9, 768) == 3
    monkeypatch.setattr(neighbours, "FOLD", 7)  # few codes: a class still has each bucket once
    codes = neighbours.corners(np.eye(4), 2, 1, 3)
    assert all(len(set(row)) == 4 for row in codes.reshape(-1, 4).tolist())


def test_neighbours_that_share_an_id(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.01, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.n_links, r.component_id, r.kept) for r in neighbours.linked(frame).collect()] == [(1, 1, True)] * 2


def test_media(spark, docs):
    got = rows_of(queries.op8_media(spark, docs))
    want = Counter()
    for i, t in corpus():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
    assert counted(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert all(r["media_bytes"] > 0 and r["feature"] and r["caption"] == f"document {r['doc_id']}" and r["position"] == 0 for r in got)


def test_images_round_trip():
    for payload in (media.padded(""), media.padded("x" * 576), media.padded("é" * 1000)):
        assert media.from_png(media.to_png(payload)) == payload
    with pytest.raises(ValueError):
        broken = bytearray(media.to_png(media.padded("abc")))
        broken[50] ^= 1
        media.from_png(bytes(broken))


def test_sequences_of_pages():
    page = "<html><head><title>t</title></head><body><p>Hello &amp; <b>you</b></p><figure><img src='a.png' alt='x'><figcaption>The  a</figcaption></figure><script>no()</script>tail<img src=b.png><figcaption>alone</figcaption></body>"
    got = media.sequence(page)
    assert [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in got] == [(0, "text", "Hello & you", None), (1, "media", "a.png", "The a"), (2, "text", "tail", None), (3, "media", "b.png", "alone")]
    assert media.sequence("") == [] and media.sequence("<p>unclosed <img") is not None


def test_open_captions_lose_no_text():
    got = media.sequence("<p>a</p><figure><img src=x><figcaption>cap<p>later text</p><p>more</p>")
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in got] == [("text", "a", None), ("media", "x", "cap later text more")]
    got = media.sequence("<figure><img src=x><figcaption>one</figure><p>after</p><figcaption>b<figcaption>c")
    assert [i["caption"] or i["text"] for i in got] == ["one", "after", "b", "c"] or got[0]["caption"] == "c"


def test_pages_with_media(spark):
    """Positions and captions of real pages stay with what their digests resolve to; unknown references stay, too."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("sequence", F.lit(1))
    pages = pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit("</script></style><figure><img src='r1'><figcaption>one</figcaption></figure><img src='none' alt='two'>")))
    stored = spark.createDataFrame([("r1", 5), ("r2", 6)], "ref string, n_bytes int")
    found = media.interleave(pages).select("page_id", "url", "sequence")
    for r in found.collect():
        assert [i["position"] for i in r["sequence"]] == list(range(len(r["sequence"])))
        assert [(i["ref"], i["caption"]) for i in r["sequence"][-2:]] == [("r1", "one"), ("none", "two")]
    got = media.resolve(found, stored, ["page_id"])
    assert got.where("caption = 'one' and n_bytes = 5").count() == got.where("caption = 'two' and n_bytes is null").count() == pages.count()


def packed_right(items, capacity=2048):
    at = defaultdict(list)
    for r in items:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in items)
    return len(at), -(-total // capacity)


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    want = Counter()
    for i, t in corpus():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    got = rows_of(queries.op9_packing(spark, docs))
    assert counted(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    used, least = packed_right(got)
    assert used <= least * 1.05 + 1


def test_dominance_keeps_optimum():
    rng = random.Random(9)
    for _ in range(60):
        capacity = 12
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        rows = packing.plan(dict(Counter(items)), capacity)
        used = int(max(r[3] + r[2] for r in rows))
        assert Counter({int(k): int(v) for k, v in zip(*np.unique(np.repeat(rows[:, 0], rows[:, 2]), return_counts=True), strict=True)}) == Counter(items)
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for x in items:
            counts[x] += 1
        fixed = sum(n for _, n in packing.reduce_by_dominance(counts, capacity))
        left = [x for x in range(capacity + 1) for _ in range(int(counts[x]))]
        assert fixed + optimum(left, capacity) == optimum(items, capacity) <= used


def test_best_fit_fills_one_sequence_before_the_next():
    for capacity, items in ((400, [250, 250, 50, 50] + [36] * 5), (200, [115, 115] + [36] * 3 + [20] * 4), (40, [21, 21, 21] + [7] * 5 + [3] * 6)):
        counts = np.bincount(items, minlength=capacity + 1)
        want = []
        for x in sorted(items, reverse=True):
            fits = [k for k, room in enumerate(want) if room >= x]
            if fits:
                want[min(fits, key=want.__getitem__)] -= x
            else:
                want.append(capacity - x)
        got = [capacity - sum(lengths) for lengths, times in packing.best_fit(counts, capacity) for _ in range(times)]
        assert sorted(got) == sorted(want)


def test_dominance_of_three_keeps_optimum():
    rng, threes = random.Random(10), 0
    for _ in range(300):
        capacity = 30
        items = [rng.randint(5, capacity) for _ in range(rng.randint(3, 9))]
        counts = np.bincount(items, minlength=capacity + 1)
        fixed = packing.reduce_by_dominance(counts, capacity)
        threes += sum(n for lengths, n in fixed if len(lengths) == 3)
        left = [x for x in range(capacity + 1) for _ in range(int(counts[x]))]
        assert sum(n for _, n in fixed) + optimum(left, capacity) == optimum(items, capacity)
    assert threes > 0


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0] and k < len(items):
            return
        if k == len(items):
            best[0] = min(best[0], len(bins))
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity:
                bins[b] += items[k]
                place(k + 1, bins)
                bins[b] -= items[k]
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def test_toxicity_on_held_out_documents(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = common.documents(spark, at), spark.read.parquet(f"{at}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    scored = toxicity.score(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    hit, false, toxic, n = scored.selectExpr("count_if(toxic = 1 and severity = 1)", "count_if(toxic = 0 and severity = 1)", "count_if(toxic = 1)", "count(*)").first()
    assert hit >= 0.85 * toxic and false <= 0.005 * (n - toxic)


def test_ordinal_thresholds_share_weights():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 4)).astype(float)
    z = x @ np.array([3.0, 2.0, 0.0, -2.0]) + rng.logistic(size=3000)
    y = np.digitize(z, [1.0, 3.0])
    w, theta = toxicity.fit_thresholds(x, y, 3, l2=0.0, steps=800, rate=0.05)
    assert np.allclose(w, [3, 2, 0, -2], atol=0.4) and np.allclose(theta, [1, 3], atol=0.4) and theta[0] < theta[1]


def test_toxicity_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 8), (None, "idiot", 9)], "doc_id long, text string, severity int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {(r.doc_id, r.expected_severity, r.severity) for r in toxicity.score(docs, model).collect()} == {(1, 0.0, 0), (2, 0.0, 0), (None, 0.0, 0)}
    assert {r.severity for r in toxicity.reject(docs, labels).collect()} == {7, 8, 9}


def test_toxicity_as_brute_force(spark):
    """Three grades: every expected severity from the class probabilities, feature by feature."""
    at = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, at), spark.read.parquet(f"{at}/labels.parquet")
    model = toxicity.fit(docs, labels, F.when(F.col("toxic") == 1, 2).otherwise(1 - F.col("quality")), features=200)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "1 2 _"), (-4, "é" * 50_000)], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(odd)
    got = {r.doc_id: (r.expected_severity, r.severity) for r in toxicity.score(every, model).select("doc_id", "expected_severity", "severity").collect()}
    for r in every.collect():
        words = {"".join(g) for alpha, g in itertools.groupby((r.text or "").lower(), key=lambda c: bool(re.match(r"[^\W\d_]", c))) if alpha}
        z = sum(v for w, v in model.words.items() if any(x.startswith(w[:-1]) if w.endswith("-") else x == w for x in words))
        upto = [1 / (1 + np.exp(z - t)) for t in model.thresholds]
        shares = [upto[0], upto[1] - upto[0], 1 - upto[1]]
        assert abs(got[r.doc_id][0] - (shares[1] + 2 * shares[2])) < 2e-6
        if min(abs(u - 0.5) for u in upto) > 1e-9:
            assert got[r.doc_id][1] == sum(u < 0.5 for u in upto)


def test_stages_keep_columns_of_their_own_names(spark):
    """Columns named like the stages' own, in any case, nested ones with odd names among them, stay as they are."""
    passage, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "wv")
    rows = [(1, passage, 1, "a", [1], (3,)), (2, passage, 2, "b", [2], (4,)), (3, f"{other} {passage} tail", 3, None, None, None), (None, None, 4, "d", [], (5,)), (None, None, 4, "d", [], (5,))]
    fields = "doc_id long, text string, _tm_found int, _TM_KEY string, _tm_emptied array<int>, _tm_n struct<`odd name`: int>"
    docs = spark.createDataFrame(rows, fields).select("*", *(F.lit(7).alias(c) for c in ("_tm_id", "_tm_other", "_tm_expected", "_Tm_Severity", "_tm_html", "k", "t", "u", "c", "low", "fp", "tkey", "a.dot", "a `tick`")))
    plain = lambda df: Counter(map(str, df.collect()))
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert plain(toxicity.reject(docs, labels)) == plain(docs)
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and sorted((r.doc_id or 0, r._tm_found) for r in one.collect()) == [(0, 4), (1, 1), (3, 3)]
    kept = substrings.strip_repeats(docs)
    assert kept.columns == docs.columns
    assert plain(kept) == plain(docs.where("doc_id is null or doc_id <> 2").withColumn("text", F.when(F.col("doc_id") == 3, f"{other} tail").otherwise(F.col("text"))))
    assert plain(media.interleave(docs, "text").drop("sequence")) == plain(docs)


def test_chat_recovers_roles(spark):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    model = chat.fit(turns.where("conv_id % 2 = 0"))
    got = chat.recover(turns.where("conv_id % 2 = 1").withColumn("stretch", F.lit(1)), model)
    right, n = got.selectExpr("count_if(role = recovered)", "count(*)").first()
    assert right >= 0.9 * n


def test_viterbi_as_all_paths():
    rng = np.random.default_rng(6)
    log = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1] or None))
    for n in range(1, 7):
        model = {"start": log(3), "move": log(3, 3), "emit": log(3, chat.SYMBOLS)}
        symbols = rng.integers(0, chat.SYMBOLS, n)
        total = lambda path: model["start"][path[0]] + sum(model["move"][a, b] for a, b in zip(path, path[1:])) + sum(model["emit"][r, s] for r, s in zip(path, symbols))  # noqa: B023, B905, E731
        best = max(itertools.product(range(3), repeat=n), key=total)
        assert tuple(chat.viterbi(model, symbols, model["start"])) == best


def test_rendering_takes_one_marker_away(spark):
    rows = spark.createDataFrame([("user", "User: assistant: x"), ("assistant", "no marker <|end|>"), ("system", None)], "recovered string, text string")
    got = [r[0] for r in rows.select(chat.render("recovered", "text")).collect()]
    assert got == ["<|user|>\nassistant: x\n<|end|>\n", "<|assistant|>\nno marker <\\|end|>\n<|end|>\n", "<|system|>\n\n<|end|>\n"]


def test_chat_stretches_as_plain_viterbi(spark, monkeypatch):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.fit(turns)
    whole = counted(rows_of(chat.recover(turns, model)), "conv_id", "turn", "recovered")
    monkeypatch.setattr(chat, "STRETCH", 2)
    assert counted(rows_of(chat.recover(turns, model)), "conv_id", "turn", "recovered") == whole


@pytest.fixture
def small_parts(spark):
    """Shuffled partitions stay apart, however small."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def odd_turns():
    """A conversation without id, one with a single turn number, one with two numbers, and turns that are equal in all columns."""
    rng, rows = random.Random(21), []
    for n, conv, numbers in ((150, None, [None]), (90, 7, [3]), (70, 8, [None, 2**40]), (9, 9, range(9)), (1, 10, [0])):
        for k in range(n):
            role = rng.choice(["system", "user", "assistant", "tool", "", None])
            rows.append((conv, numbers[k % len(numbers)], role, rng.choice([None, "User: hi?", "Assistant: so\nit is", f"text {rng.randint(0, 99)}"])))
    rows += [(None, None, None, None)] * 60
    rng.shuffle(rows)
    return rows, "conv_id long, turn long, role string, text string"


def in_order(rows):
    """Turns of each conversation, nulls first."""
    first = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, (v or "").encode())
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    return {c: sorted(own, key=lambda r: (first(r[1]), text(r[3]), text(r[2]))) for c, own in convs.items()}


def test_chat_stretches_of_odd_turn_numbers(spark, monkeypatch, small_parts):
    rows, kind = odd_turns()
    frame = spark.createDataFrame(rows, kind).repartition(3)
    rng = np.random.default_rng(5)
    model = {"start": rng.normal(size=3), "move": 0.5 * rng.normal(size=(3, 3)), "emit": rng.normal(size=(3, chat.SYMBOLS))}
    total = lambda path, seen: model["start"][path[0]] + model["move"][path[:-1], path[1:]].sum() + model["emit"][path, seen].sum()
    monkeypatch.setattr(chat, "STRETCH", 8)
    found, parts, joined = sorted(chat.stretches(frame).collect(), key=lambda r: r.stretch), defaultdict(list), defaultdict(list)
    for r in found:
        parts[r.conv_id].append(np.array([t.symbol for t in r.turns]))
        joined[r.conv_id] += [(r.conv_id, t.turn, t.role, t.text) for t in r.turns]
    assert joined == in_order(rows)
    assert max(len(r.turns) for r in found) <= 8 and len({r.stretch for r in found}) == len(found)
    assert len({r.stretch >> 32 for r in found if r.conv_id is None}) > 1
    want = Counter()
    for conv, own in parts.items():
        path = []
        for seen, (first, last) in zip(own, chat.borders(model, [chat.summed(model, x) for x in own]), strict=True):
            enter = np.full(3, -np.inf)
            enter[first] = 0.0
            path += chat.viterbi(model, seen, enter, last).tolist()
        seen = np.concatenate(own)
        # Paths of equal score are equally right; equal turns in a row make many of them.
        assert np.isclose(total(np.array(path), seen), total(chat.viterbi(model, seen, model["start"]), seen))
        want.update((conv, r[1], r[2], chat.ROLES[p]) for r, p in zip(joined[conv], path, strict=True))
    assert counted(rows_of(chat.recover(frame, model)), "conv_id", "turn", "role", "recovered") == want


def test_chat_fit_over_borders_and_unlabelled_turns(spark, monkeypatch, small_parts):
    rows, kind = odd_turns()
    frame = spark.createDataFrame(rows, kind).repartition(3)
    start, move = np.ones(3), np.ones((3, 3))
    for own in in_order(rows).values():
        for k, r in enumerate(own):
            if r[2] in chat.ROLES:
                to = chat.ROLES.index(r[2])
                if not k:
                    start[to] += 1
                elif own[k - 1][2] in chat.ROLES:
                    move[chat.ROLES.index(own[k - 1][2]), to] += 1
    monkeypatch.setattr(chat, "STRETCH", 8)
    model = chat.fit(frame)
    assert np.allclose(np.exp(model["start"]), start / start.sum()) and np.allclose(np.exp(model["move"]), move / move.sum(axis=1, keepdims=True))
    monkeypatch.setattr(chat, "STRETCH", 4096)
    assert all(np.array_equal(model[k], v) for k, v in chat.fit(frame).items())


def test_chat_markers_and_nulls(spark):
    rows = [(1, 0, None, "User: hello?"), (1, 1, None, "Assistant: hi <|x|>"), (None, None, None, None), (1, 1, None, "Assistant: hi <|x|>")]
    got = chat.recover(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4 and {(r.turn, r.recovered) for r in got if r.conv_id == 1} == {(0, "user"), (1, "assistant")}
    assert {r.rendered for r in got if r.turn == 1} == {"<|assistant|>\nhi <\\|x|>\n<|end|>\n"}


def test_transcripts(spark):
    raw = spark.createDataFrame([(1, "System: be kind\nUser: hello\nthere?\nAssistant: hi"), (2, None)], "doc_id long, text string")
    turns = chat.parse_transcripts(raw)
    got = sorted((r.turn, r.recovered, r.rendered) for r in chat.recover(turns).collect() if r.conv_id == 1)
    assert [g[1] for g in got] == ["system", "user", "assistant"] and "hello\nthere?" in got[1][2]


def test_pipeline_as_brute_force(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    base = [(i, t) for i, t in corpus() if i is not None and t and "idiot" not in t]
    seen, rows = set(), []
    for i, t in base:
        if i not in seen:
            rows.append((i, t))
            seen.add(i)
    rows += [(200 + k, " ".join(rng.choice(["idiot", "scum", "of", "and"]) for _ in range(30))) for k in range(30)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = [(i, t) for i, t in rows if i < 200]
    _, roots = simhash_groups(now)
    low = {}
    for (i, _), r in zip(now, roots, strict=True):
        low[r] = min(low.get(r, i), i)
    now = [(i, t) for (i, t), r in zip(now, roots, strict=True) if low[r] == i]
    kept = {}
    for (i, t), (_, w, k) in zip(now, stripped([(i, SPLIT.findall(t.encode())) for i, t in now]), strict=True):
        if len(w) == len(k):
            kept[i] = t
        elif k:
            kept[i] = b" ".join(k).decode()
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    want = Counter()
    for i, t in kept.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want.update((i, k // 2048, len(ids[k : k + 2048])) for k in range(0, len(ids), 2048))
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    assert counted(got, "doc_id", "piece", "length") == want
    packed_right(got)
