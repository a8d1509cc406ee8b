"""Registered queries of the operators, and the SQL that states some of them."""

from __future__ import annotations

import os

import public_tokenizers

from . import bpe, chat, common, divergence, media, mixing, neighbours, packing, repeats, resampling, simhash, substrings, toxicity, warc

#: Where the tokenizer's file is; a parameter of the operators.
VOCABULARY = os.environ.get("TIDEMARK_VOCABULARY") or public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark, sf_dir):
    return bpe.encode_documents(common.documents(spark, sf_dir), VOCABULARY)


def op2_warc(spark, sf_dir):
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def op3_repeats(spark, sf_dir):
    return repeats.remove_repeats(common.documents(spark, sf_dir), 400)


def op4_substrings(spark, sf_dir):
    return substrings.remove_repeats(common.documents(spark, sf_dir), 13)


def op5_chat(spark, sf_dir):
    return chat.recover(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_toxicity(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select("doc_id", "text"), model).drop("text")


def op7_neighbours(spark, sf_dir):
    return neighbours.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_media(spark, sf_dir):
    return media.document_media(common.documents(spark, sf_dir))


def op9_packing(spark, sf_dir):
    return packing.pack_documents(common.documents(spark, sf_dir), VOCABULARY, 2048)


def op10_simhash(spark, sf_dir):
    found = simhash.groups(common.documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op11_divergence(spark, sf_dir):
    """Divergences of every (lang, source) from the others of its language, and its overused words."""
    return divergence.audit(common.documents(spark, sf_dir))


def op12_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.mix(common.documents(spark, sf_dir))


def op13_resampling(spark, sf_dir):
    """Scores of all documents against the benchmark's distribution, and the ranks of the drawn ones."""
    return resampling.resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_warc, op3_repeats, op4_substrings, op5_chat, op6_toxicity, op7_neighbours, op8_media, op9_packing, op10_simhash, op11_divergence, op12_mixing, op13_resampling)
}

def _simhash_sql() -> str:
    """SQL of op10: XXH64 in 128-bit arithmetic, one step a column, as DuckDB has no such function."""
    p = [0, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
    full, seed = "18446744073709551616::UHUGEINT", 42
    times = lambda x, k: f"(({x}) * {p[k]}::UHUGEINT % {full})"
    turned = lambda x, n: f"(({x}) * {1 << n}::UHUGEINT % {full} + ({x}) // {1 << 64 - n}::UHUGEINT)"
    number = lambda at, n: "CAST('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + " AS UBIGINT)::UHUGEINT"
    mixed = lambda x: times(turned(x, 31), 1)
    start = [(seed + p[1] + p[2]) % (1 << 64), (seed + p[2]) % (1 << 64), seed, (seed - p[1]) % (1 << 64)]
    stripes = ", ".join(
        f"list_reduce(list_transform(range(n // 32), lambda i: lanes[4 * i + {k + 1}]), lambda v, y: {mixed(f'(v + y) % {full}')}, {start[k]}::UHUGEINT) AS v{k}" for k in range(4)
    )
    joined = " + ".join(turned(f"v{k}", n) for k, n in enumerate((1, 7, 12, 18)))
    folded = f"list_reduce([{', '.join(mixed(times(f'v{k}', 2)) for k in range(4))}], lambda h, y: ({times('xor(h, y)', 1)} + {p[4]}::UHUGEINT) % {full}, ({joined}) % {full})"
    bits = " + ".join(f"CASE WHEN 2 * sum(h // {1 << k}::UBIGINT % 2) > count(*) THEN {1 << k}::HUGEINT ELSE 0 END" for k in range(64))
    return rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS k FROM documents),
        w AS (SELECT k, array_to_string(ws[i:i + 3], ' ') AS shingle FROM (SELECT *, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
        x AS (SELECT shingle, hex(encode(shingle)) AS x, octet_length(encode(shingle)) AS n FROM (SELECT DISTINCT shingle FROM w)),
        a AS (SELECT *, list_transform(range(n // 8), lambda i: {number("8 * i", 8)}) AS y FROM x),
        b AS (SELECT *, list_transform(y, lambda i: {times("i", 2)}) AS lanes FROM a),
        s AS (SELECT *, {stripes} FROM b),
        h0 AS (SELECT *, CASE WHEN n < 32 THEN {seed + p[5]}::UHUGEINT ELSE {folded} END + n::UHUGEINT AS h FROM s),
        h1 AS (SELECT shingle, x, n, list_reduce(list_transform(lanes[4 * (n // 32) + 1:], lambda i: {mixed("i")}), lambda h, i: ({times(turned("xor(h, i)", 27), 1)} + {p[4]}::UHUGEINT) % {full}, h % {full}) AS h FROM h0),
        h2 AS (SELECT shingle, x, n, CASE WHEN n % 8 < 4 THEN h ELSE xor(h, {times(number("n // 8 * 8", 4), 1)}) END AS h FROM h1),
        h3 AS (SELECT shingle, x, n, CASE WHEN n % 8 < 4 THEN h ELSE ({times(turned("h", 23), 2)} + {p[3]}::UHUGEINT) % {full} END AS h FROM h2),
        h4 AS (SELECT shingle, list_reduce(list_transform(range(n // 4 * 4, n), lambda i: {number("i", 1)}), lambda h, i: {times(turned(f"xor(h, i * {p[5]}::UHUGEINT % {full})", 11), 1)}, h) AS h FROM h3),
        h5 AS (SELECT shingle, {times(f"xor(h, h // {1 << 33}::UHUGEINT)", 2)} AS h FROM h4),
        h6 AS (SELECT shingle, {times(f"xor(h, h // {1 << 29}::UHUGEINT)", 3)} AS h FROM h5),
        h7 AS (SELECT shingle, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM h6),
        f AS (SELECT k, {bits} AS fp FROM w JOIN h7 USING (shingle) GROUP BY k),
        g AS (SELECT doc_id, coalesce(fp, 0) AS fp FROM d LEFT JOIN f USING (k)),
        u AS (SELECT fp, min(doc_id) AS low FROM g GROUP BY fp),
        l AS (SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 4),
        r AS (SELECT fp, fp AS met FROM u UNION SELECT r.fp, l.b FROM r JOIN l ON r.met = l.a),
        c AS (SELECT r.fp, min(u.low) AS component_id FROM r JOIN u ON u.fp = r.met GROUP BY r.fp)
        SELECT doc_id, lower(printf('%016x', fp::UBIGINT)) AS fingerprint, component_id FROM g JOIN c USING (fp)"""


ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, b FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS response_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> response_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> response_id THEN response_id END AS refers_to
        FROM m""",
    "op3_repeats": r"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, row_number() OVER () AS k FROM documents),
        h AS (SELECT k, hex(b) AS x, octet_length(b) AS n FROM d),
        c AS (SELECT k, n, first, substr(x, 2 * first + 1, 8990) AS piece FROM (SELECT *, unnest(range(0, n - 399, 4096)) AS first FROM h)),
        w AS (SELECT k, first + i AS i, md5(substr(piece, 2 * i + 1, 800)) AS win FROM (SELECT *, unnest(range(0, least(4096, n - 399 - first))) AS i FROM c)),
        f AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
        g AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM w SEMI JOIN f USING (win)),
        r AS (SELECT k, min(i) AS a, max(i) + 400 AS z FROM (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY i) AS run FROM g) GROUP BY k, run),
        s AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY k ORDER BY a) AS since FROM r),
        t AS (SELECT k, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept FROM s JOIN h USING (k) GROUP BY k)
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256 FROM d LEFT JOIN t USING (k)""",
    "op4_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS k FROM documents),
        w AS (SELECT k, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d)),
        f AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win HAVING count(*) > 1),
        g AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS j FROM w JOIN f USING (win) WHERE low < doc_id),
        s AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
        c AS (SELECT s.k, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY s.j) FILTER (g.j IS NULL) AS kept FROM s LEFT JOIN g ON g.k = s.k AND g.j = s.j GROUP BY s.k)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (k)""",
    "op7_neighbours": """
        WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
        r AS (SELECT vec_id AS node, vec_id AS met FROM e UNION SELECT r.node, l.b FROM r JOIN l ON r.met = l.a),
        c AS (SELECT node, min(met) AS component_id FROM r GROUP BY node),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id""",
    "op10_simhash": _simhash_sql(),
    "op11_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS k FROM documents),
        w AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS df FROM w GROUP BY ALL),
        t AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING sum(df) >= 3),
        l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM t GROUP BY lang),
        e AS (SELECT c.lang, c.source, term, c.n::HUGEINT AS n, t.n AS lang_n FROM c JOIN t USING (lang, term)),
        g AS (SELECT DISTINCT lang, source FROM d),
        s AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce((SELECT sum(n) FROM e WHERE e.lang = g.lang AND e.source = g.source), 0)::HUGEINT AS total FROM g LEFT JOIN l ON l.lang = g.lang),
        p AS (SELECT s.lang, s.source, t.term, e.n, 1 + (1000000000 * (coalesce(e.n, 0) + 1)) // (s.total + s.v) AS p, 1 + (1000000000 * (t.n + 1)) // (s.lang_total + s.v) AS lang_p FROM s JOIN t ON t.lang = s.lang LEFT JOIN e ON e.lang = s.lang AND e.source = s.source AND e.term = t.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - lang_p) * (p - lang_p) // lang_p FROM p WHERE n > 0 AND p > lang_p),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op12_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
        v AS (SELECT *, 3 * size / w AS ratio, CAST(sum(size) OVER () - (sum(3 * size) OVER o - 3 * size) AS DOUBLE) / (sum(w) OVER (ORDER BY 3 * size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
              FROM s WINDOW o AS (ORDER BY 3 * size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT source, size AS source_size, CASE WHEN ratio < level THEN CAST(3 * size AS DOUBLE) ELSE (max(level) FILTER (ratio >= level) OVER ()) * w END AS target FROM v),
        g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
        b AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN goal % source_size ELSE 0 END AS extra,
              sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target, CAST(size * whole + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM b""",
    "op13_resampling": r"""
        WITH a AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS k, text FROM documents UNION ALL SELECT 'b', NULL, 0, text FROM benchmark),
        w AS (SELECT side, k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM a),
        tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
        h AS (SELECT word, xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), tab),
        f AS (SELECT side, k, bucket FROM w JOIN h USING (word)),
        c AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
        n AS (SELECT k, count(*) AS n, sum(gain)::BIGINT AS gain FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY k),
        u AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(CAST(floor(gain::DOUBLE / n) AS BIGINT), 0) AS weight, (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM a LEFT JOIN n USING (k) WHERE side = 'd'),
        x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM u),
        r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM x)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM r""",
}
