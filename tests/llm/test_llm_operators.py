"""Operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import ann_search, components, exact_topk, language_id, near_texts, piece_codec, quality_model, simhash_dedup, source_mix, substring_dedup, token_count, warc_derivatives
from episodica.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, k string, p double, r string"
EDGES = [
    (1, None, None, None, None, "a", "b", "c", 1.0, "r"), (2, "", "en", "s", 0, "a", "b", "c", 1.0, "r"), (3, " \n\t", "en", "s", 3, "a", "b", "c", None, None),
    (None, "the cat sat", "en", "s", 11, None, None, None, None, None), (5, "the cat sat", "en", None, 11, "a", "b", "c", 1.0, "r"), (5, "the cat sat", "en", None, 11, "a", "b", "c", 1.0, "r"),
    (6, "x" * 300_000, "en", "t", 1, "a", "b", "c", 1.0, "r"), (7, "1234 !!", "de", "t", 1, "a", "b", "c", 1.0, "r"), (8, "wort " * 60_000, "de", "t", 1, "a", "b", "c", 1.0, "r"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_on_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.identify_held_out(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert r.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark, edges):
    got = language_id.identify_held_out(edges).collect()
    assert len(got) == len(EDGES)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 7))
    assert all(r.lang_pred in ("en", "de") for r in got if r.doc_id in (5, 6, 8))
    assert language_id.identify_held_out(edges.limit(0)).count() == 0


def test_language_of_numerals_without_letters(spark):
    rows = [(k, "the cat sat on the mat", "en") for k in range(40)] + [(k, "der Hund lag auf der Matte", "de") for k in range(40, 80)]
    rows += [(100, "½ ② ²", "en"), (101, "Ⅷ 12", None), (102, "x²", None)]
    got = {r.doc_id: r for r in language_id.identify_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (100, 101)) and got[102].lang_pred != "und"


def test_every_language_is_learned(spark):
    rows = [(9 * n + k, f"w{n:03d}xyz" * 3, f"l{n:03d}") for n in range(230) for k in range(9)]
    model = language_id.fit(spark.createDataFrame([(i, t.translate(str.maketrans("0123456789", "abcdefghij")), x) for i, t, x in rows], "doc_id long, text string, lang string"))
    assert len(model.langs) == 230
    assert language_id.fit(spark.createDataFrame([(None, f"text {chr(97 + k % 26)}", "en") for k in range(9000)], "doc_id long, text string, lang string")).langs == ["en"]


def plain_language_score(model, text):
    """A text's probabilities by loops: every n-gram of every word on its own."""
    import xxhash

    s, total, n = model.settings, np.zeros(len(model.langs)), 0
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        if not any(map(str.isalpha, word)):
            continue
        marked, found = f"<{word}>", [xxhash.xxh64_intdigest(word, s.seed) % s.buckets]
        for size in range(s.least, s.most + 1):
            for i in range(len(marked) - size + 1):
                h = 14695981039346656037 - size
                for c in marked[i : i + size]:
                    h = (h ^ ord(c)) * 1099511628211 % 2**64
                found.append((h ^ h >> 29) % s.buckets)
        for b in found:
            total, n = total + model.logits[b], n + 1
    z = np.exp((total / n + model.bias) / model.temperature) if n else np.ones(len(model.langs))
    return z / z.sum(), n


def test_few_texts_of_very_many_languages(spark):
    rows = [(k, f"text {k}", f"l{k % 800:03}") for k in range(3200)] + [(10_000 + k, f"the cat sat on mat {k}", "big") for k in range(5000)]
    sizes = {f"l{k:03}": 4 for k in range(800)} | {"big": 5000}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for quota in (1, 3, 30):
        found = {r.lang: r["count"] for r in language_id.sampled(docs, sizes, quota, 7, "doc_id", "text", "lang").groupBy("lang").count().collect()}
        assert found == {lang: min(n, quota) for lang, n in sizes.items()}


def test_language_scores_equal_a_loop(spark, docs, edges):
    model = language_id.fit(docs)
    for df in (docs.limit(60), edges):
        texts = {r.doc_id: r.text or "" for r in df.collect() if len(r.text or "") < 20_000}
        for r in language_id.predict(df, model).collect():
            if r.doc_id in texts:
                p, n = plain_language_score(model, texts[r.doc_id])
                want = (model.langs[int(p.argmax())], p.max()) if n else ("und", 0.0)
                assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], abs=1e-6)


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", '<html lang="de"><title>T &amp; t</title><script>var x="<p>";</script><p>One<br>two</p><a href="/b">c</a></html>'), (2, None, None), (3, "http://c/", ""), (3, "http://c/", "")], "page_id long, url string, html string")
    source = warc_derivatives.responses(pages)
    out = warc_derivatives.derive(source)
    rows = out.collect()
    assert len(rows) == 8 and {r.record_type for r in rows} == {"metadata", "conversion"}
    ids = {r.page_id: (r.record_id, r.payload_digest) for r in source.collect()}
    assert all((r.refers_to, r.source_digest) == ids[r.page_id] and r.content_length == len(r.block.encode()) for r in rows)
    assert next(r.block for r in rows if r.page_id == 1 and r.record_type == "conversion") == "T & t\nOne\ntwo\nc"
    assert next(r.n_links for r in rows if r.page_id == 1) == 1
    warc_derivatives.write_records(out, str(tmp_path / "w"))
    back = warc_derivatives.read_records(spark, str(tmp_path / "w")).collect()
    assert len(back) == 8 and all(r.complete for r in back)
    assert {(r.headers["WARC-Record-ID"], r.headers["WARC-Refers-To"], r.block) for r in back} == {(r.record_id, r.refers_to, r.block) for r in rows}
    assert all(r.source_headers.startswith("HTTP/1.1 200 OK") for r in rows)


def plain_digest(raw):
    import base64
    import hashlib

    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_warc_links_and_digests_of_all_pages(spark):
    """Every record against digests and lengths made from the pages themselves."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html = {r.page_id: (r.url or "", r.html or "") for r in pages.collect()}
    rows = QUERIES["op2_warc_derivatives"](spark, DATA).collect()
    assert len(rows) == 2 * len(html) and len({r.record_id for r in rows}) == 2 * len(html)
    for r in rows:
        url, page = html[r.page_id]
        assert r.source_digest == plain_digest(page.encode()) and r.target_uri == url
        assert r.block_digest == plain_digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert f"Content-Length: {len(page.encode())}\r\n" in r.source_headers
        if r.record_type == "conversion":
            assert "<script" not in r.block and r.n_words == len(r.block.split())


def test_warc_edges(spark, tmp_path):
    text = "a line\nWARC/1.0\r\nWARC-Type: conversion\r\n\r\nmore"  # a version line within the body ends nothing
    rows = [(1, "u", f"<p>{text}</p>", "x", "y"), (2, "u", "<p>" + "wort " * 200_000, None, "y"), (3, None, None, None, None)]
    pages = spark.createDataFrame(rows, "record_id long, url string, html string, body string, block string")
    out = warc_derivatives.derive(warc_derivatives.responses(pages, id_col="record_id"), id_col="record_id")
    assert sorted(r.source_record_id for r in out.collect()) == [1, 1, 2, 2, 3, 3]
    blocks = out.withColumn("block", F.when(F.col("record_type") == "conversion", F.lit(text)).otherwise(F.col("block"))).withColumn("content_length", F.octet_length("block"))
    warc_derivatives.write_records(blocks, str(tmp_path / "w"))
    back = warc_derivatives.read_records(spark, str(tmp_path / "w")).collect()
    assert len(back) == 6 and all(r.complete for r in back) and sum(r.block == text for r in back) == 3
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")
    assert [(r.block, r.complete) for r in warc_derivatives.read_records(spark, str(tmp_path / "cut")).collect()] == [("short", False)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_derivatives.derive(warc_derivatives.responses(empty)).count() == 0


def targets_by_rounds(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop those that are full, share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, full, left = {s: weights[i % 3] for i, s in enumerate(names)}, {}, set(names)
    while True:
        rest = sum(sizes.values()) - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return {**full, **share}
        full |= {s: most * sizes[s] for s in over}
        left -= over


def test_mix_targets(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 12):
        sizes = {f"s{k}": rng.choice([0, 1, 7, 50, 1000, 90_000]) for k in range(n)} | {None: 33}
        got = {r.source: r.target for r in source_mix.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert got == pytest.approx(targets_by_rounds(sizes))


def test_mix_is_balanced_and_repeatable(spark, docs, edges):
    r = source_mix.mix_sources(docs).cache()
    assert r.exceptAll(source_mix.mix_sources(docs.repartition(3))).count() == 0
    assert r.where("taken > 3 * size or taken < 0 or taken <> copies * size").count() == 0
    by = r.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("s"), F.sum("size").alias("n"))
    assert all(abs(x.t - x.s) <= 0.05 * x.t + 60 for x in by.collect())
    e = source_mix.mix_sources(edges)
    assert e.count() == len(EDGES) and e.where("doc_id = 1").first().size == 0
    assert source_mix.mix_sources(edges.limit(0)).count() == 0
    assert source_mix.mixed_documents(edges).columns == edges.columns


def test_mix_flight_keeps_both_totals():
    rng = random.Random(2)
    rows = sorted(((0, rng.random(), 1.0, float(rng.randint(1, 500)), bytes([k % 256, k // 256]), k) for k in range(2000)), key=lambda x: -x[3])
    out = dict(source_mix.fly(iter(rows), False))
    assert sum(0 < p < 1 for p in out.values()) <= 2
    assert sum(out.values()) == pytest.approx(sum(x[1] for x in rows))
    assert sum(out[x[5]] * x[3] for x in rows) == pytest.approx(sum(x[1] * x[3] for x in rows))
    landed = dict(source_mix.fly(iter(rows), True))
    assert set(landed.values()) <= {0.0, 1.0}


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    prints = sorted(prints)
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    u = np.array(prints, dtype=np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= bits):
            a, b = find(prints[i]), find(prints[i + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in prints}


def test_fingerprints(spark, docs):
    texts = docs.collect()[:60]
    got = {r.doc_id: r.fingerprint for r in simhash_dedup.simhash_classes(docs).collect()}
    assert all(got[r.doc_id] == f"{plain_fingerprint(r.text):016x}" for r in texts)
    assert simhash_dedup.fingerprint("a b") == plain_fingerprint("a b") and simhash_dedup.fingerprint(None) == 0


def crowded(n, seed):
    """Fingerprints in a few dense balls and some at large."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n // 4)} | {0, 2**64 - 1}
    centres = [rng.getrandbits(64) for _ in range(4)]
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


@pytest.mark.parametrize("leaf", [2048, 40])
def test_links_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash_dedup, "LEAF_ROWS", leaf)  # a small one makes crowded nodes refine
    prints = crowded(1500, leaf)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {r.node: r.root for r in components.components(simhash_dedup.links(df)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for x in prints:
        groups[got.get(signed(x), signed(x))].add(x)
    for x, root in brute_components(prints, 2).items():
        want[root].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(300) if i % 50] + [(7, 7), (1000, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got[1000] == 1 and got[50] == 1 and got[51] == 51 and got[100] == 51


def test_simhash_edges(spark, edges):
    got = {(r.doc_id, r.component_id, r.fingerprint) for r in simhash_dedup.simhash_classes(edges).collect()}
    assert {c for d, c, _ in got if d in (1, 2, 3)} == {1} and {f for d, _, f in got if d in (1, 2, 3)} == {"0" * 16}
    assert {c for d, c, _ in got if d in (None, 5)} == {5}
    assert simhash_dedup.simhash_classes(edges.limit(0)).count() == 0
    kept = simhash_dedup.one_of_each(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7, 8]


@pytest.fixture(scope="module")
def families(spark):
    """Originals with near copies at graded similarities, a family of many tight copies, and unlike texts."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for edits in (0, 1, 2, 3, 12, 25, 40):
        for _ in range(12):
            text = rng.choices(words, k=200)
            copy = list(text)
            for at in rng.sample(range(200), edits):
                copy[at] = "new"
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
    crowd = rng.choices(words, k=200)
    for k in range(200):
        copy = list(crowd)
        copy[rng.randrange(200)] = f"x{k}"
        rows.append((len(rows), " ".join(copy)))
    return rows


def plain_owners(rows, least=0.8):
    """The smallest id of each connected class, by all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    owner = list(range(len(rows)))

    def top(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9 and top(i) != top(j):
                owner[max(top(i), top(j))] = min(top(i), top(j))
    return {rows[i][0] for i in range(len(rows)) if top(i) == i}


@pytest.fixture(scope="module")
def loose_families():
    """Groups whose pairs have similarities all about the least one, so that most are told by the texts."""
    rng = random.Random(11)
    words, rows = [f"w{k}" for k in range(3000)], []
    for size, edits in ((40, 2), (40, 3), (40, 4), (60, 5), (20, 1), (30, 8)):
        text = rng.choices(words, k=150)
        for _ in range(size):
            copy = list(text)
            for at in rng.sample(range(150), edits):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("leaf", [4096, 25])
def test_near_texts_against_brute_force(spark, monkeypatch, families, leaf):
    monkeypatch.setattr(near_texts, "LEAF_ROWS", leaf)  # small ones make nodes large: pivots and tiles
    kept = {r.doc_id for r in near_texts.one_of_each(spark.createDataFrame(families, "doc_id long, text string")).collect()}
    assert kept == plain_owners(families)


@pytest.mark.parametrize("leaf, held", [(4096, 50), (25, 1_000_000)])
def test_near_texts_about_the_least_similarity(spark, monkeypatch, loose_families, leaf, held):
    monkeypatch.setattr(near_texts, "LEAF_ROWS", leaf)
    monkeypatch.setattr(near_texts, "HELD_PAIRS", held)
    kept = {r.doc_id for r in near_texts.one_of_each(spark.createDataFrame(loose_families, "doc_id long, text string")).collect()}
    want = plain_owners(loose_families)
    assert 10 < len(want) < len(loose_families) - 50
    assert kept == want


def test_short_near_copies_are_told_exactly(spark):
    """A text of eight words and the same with one more share 4 of 5 shingles."""
    rng = random.Random(9)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
    kept = {r.doc_id for r in near_texts.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * k for k in range(150)}


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 60, (2, 90))
    label = np.arange(60)
    simhash_dedup.merge_labels(label, a[:20], b[:20])
    keep = near_texts.forest(label, a, b, rng.integers(100, 200, 90))
    got, want = label.copy(), label.copy()
    simhash_dedup.merge_labels(got, a[keep], b[keep])
    simhash_dedup.merge_labels(want, a, b)
    assert (got == want).all() and len(keep) == len(np.unique(label)) - len(np.unique(want))


def test_near_texts_edges(spark, edges):
    kept = near_texts.one_of_each(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7, 8]
    assert near_texts.one_of_each(edges.limit(0)).count() == 0


def vectors_with_edges():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16)).round(2).tolist()
    for k in range(100, 200):
        v[k] = v[40]  # copies, so ties
    v[0] = [x * 50 for x in v[0]]
    rows = list(enumerate(v)) + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0, 2.0]), (1100, []), (1101, [2.0, 2.0]), (20, v[20]), (None, v[7])]
    return rows


def brute(rows, score, usable):
    rows = [(i, v) for i, v in rows if v and usable(v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in rows if i is not None and i % 20 == 0}:
        best = sorted(((-score(a, v), 2**63 if i is None else i) for i, v in rows if i != q and len(v) == len(a)))[:20]
        out |= {(q, k + 1, None if i == 2**63 else i, -s) for k, (s, i) in enumerate(best)}
    return out


def fine(v):
    return all(x is not None and np.isfinite(x) for x in v)


def in_order(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


def test_nearest_equal_brute_force(spark):
    rows = vectors_with_edges()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in ann_search.nearest(df).collect()}
    assert got == brute(rows, in_order, lambda v: fine(v) and any(v))
    assert ann_search.nearest(df.limit(0)).count() == 0


def crowded_vectors():
    """Far more rows of a query's id, and of other ids, with one vector than a query's list is long; and vectors near the ends of the range."""
    rng = np.random.default_rng(8)
    same, other = rng.normal(size=8).round(2).tolist(), rng.normal(size=8).round(2).tolist()
    rows = [(0, same)] * 25 + [(1, same), (2, same)] + [(40, same)] * 30 + [(7, same)] * 45 + [(k, same) for k in range(100, 150)] + [(60, other)] * 3
    return rows + list(enumerate(rng.normal(size=(60, 8)).round(2).tolist(), 200))


def test_repeated_rows_lose_nothing(spark):
    rows = crowded_vectors()
    df = spark.createDataFrame([(i, v, "x", -1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, query_id string, rank int, score double")

    def want(score):  # as a bag: a candidate that repeats is found as often
        out = []
        for q, a in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
            best = sorted((-score(a, v), i) for i, v in rows if i != q)[:20]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        return sorted(out)

    assert sorted(tuple(r) for r in ann_search.nearest(df).collect()) == want(in_order)
    whole = lambda a, b: sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b))
    assert sorted(tuple(r) for r in exact_topk.top_scores(df).collect()) == want(whole)


def test_vectors_at_the_ends_of_the_range(spark):
    rows = [(0, [1e160, 0.0]), (1, [1e160, 1.0]), (2, [1.0, 1.0]), (3, [-1e200, 1e200]), (20, [1e-300, 1e-310]), (21, [5e-324, 0.0]), (40, [2.0**57, 1.0]), (41, [3.0, 4.0]), (60, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann_search.nearest(df).collect()}
    assert near[0, 1] == (1, float("inf")) and len(near) == 4 * 8
    assert near[60, 1][0] == 3 and all(s == s for _, s in near.values())
    with pytest.raises(Exception):  # scores that no long holds are among the best
        exact_topk.top_scores(df).collect()


def test_scores_of_wide_vectors_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).round(2).tolist()) for k in range(120)]
    rows[0] = (0, [1.0, 0.0, 0.0, 0.0])
    rows += [(200, [1e9, 0.5, 0.0, 0.0]), (201, [1e9, 0.5, 0.0, 0.0]), (202, [-1e12, 1e7, 0.0, 0.0]), (220, [0.0, 0.0, 0.0, 1e12]), (221, [0.0, 0.0, 1e14, 0.0]), (223, [0.0, 2.0**53 + 2, 0.0, 3e7])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    score = lambda a, b: sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b))
    some = [(i, v) for i, v in rows if i not in (200, 221, 223)]
    small = df.where("vec_id not in (200, 221, 223)")
    got = {tuple(r) for r in exact_topk.top_scores(small, k=5).collect()}
    assert got == {x for x in brute(some, score, fine) if x[1] <= 5}
    assert (0, 1, 201, 64 * 64 * 10**9) in got
    with pytest.raises(Exception):
        exact_topk.top_scores(df).collect()  # 200 with 201 is beyond a long


def test_top_scores_equal_brute_force(spark):
    rows = vectors_with_edges()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    score = lambda a, b: sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b))
    got = {tuple(r) for r in exact_topk.top_scores(df).collect()}
    assert got == brute(rows, score, fine)
    assert exact_topk.top_scores(df.limit(0)).count() == 0


def test_pieces_equal_the_library_without_dropout_and_decode(spark, docs, edges):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = {r.doc_id: r.pieces for r in piece_codec.encode(docs, dropout=0.0).collect()}
    assert all(plain[k] == library.encode(t) for k, t in texts.items())
    varied = piece_codec.encode(docs, dropout=0.2).cache()
    assert varied.where("not lossless").count() == 0
    assert {r.doc_id: r.text for r in piece_codec.decode(varied).collect()} == texts
    assert sum(r.pieces != plain[r.doc_id] for r in varied.collect()) > 150
    assert varied.exceptAll(piece_codec.encode(docs.repartition(3), dropout=0.2)).count() == 0
    got = piece_codec.encode(edges).collect()
    assert all(r.lossless for r in got) and [r.n_pieces for r in got if r.doc_id in (1, 2)] == [0, 0]


def test_any_text_decodes():
    rng, p = random.Random(6), piece_codec.pieces(None)
    e = piece_codec.Encoder(p, 0.3, 1, 4)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "中", "😀", "▁", "<s>", "\x00", "ing"]
    for k in range(3000):
        s = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        assert p.decode(e(s, str(k)).tolist()) == s


def test_every_occurrence_is_segmented_anew(spark):
    text = "preparation of demonstration recordings " * 30
    rows = piece_codec.encode(spark.createDataFrame([(k, text) for k in range(60)], "doc_id long, text string")).collect()
    assert all(r.lossless for r in rows) and len({tuple(r.pieces) for r in rows}) == 60
    rng, p = random.Random(7), piece_codec.pieces(None)
    e, keys = piece_codec.Encoder(p, 0.1, 11), [*map(str, range(20_000))]
    got = [tuple(x.tolist()) for x in e.many(["demonstration"] * 20_000, keys)]
    assert all(got[k] == tuple(e("demonstration", str(k)).tolist()) for k in range(0, 20_000, 400))
    want = [tuple(p.encode_unit(" demonstration", [i for i in range(100) if rng.random() < 0.1])[1]) for _ in range(20_000)]
    assert all(abs(got.count(x) - want.count(x)) < 400 for x in {*got, *want}) and len(set(got)) > 5
    e = piece_codec.Encoder(p, 0.1, 11)  # what is remembered changes nothing
    assert [tuple(x.tolist()) for x in e.many(["demonstration"] * 20_000, keys[::-1])] == got[::-1]


def plain_segments(p, unit, dropped):
    """The agenda by a plain list: the best candidate of all is looked for anew each time; ``dropped`` says of each that comes up whether it is skipped."""
    symbols = [*unit.replace(" ", piece_codec.SPACE)]
    blocked, at = set(), [*range(len(symbols))]  # a skipped candidate is known by its place and its two symbols
    while True:
        found = [(p.rank[a + b], at[k], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in p.rank and (at[k], a, b) not in blocked]
        if not found:
            break
        k = min(found)[2]
        if dropped():
            blocked.add((at[k], symbols[k], symbols[k + 1]))
        else:
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del at[k + 1]
    return [i for s in symbols for i in ([p.id[s]] if s in p.id else [p.byte[b] for b in (" " if s == piece_codec.SPACE else s).encode()])]


def test_dropout_equals_a_plain_agenda(docs):
    import xxhash

    p, full = piece_codec.pieces(None), 2**64 - 1
    texts = [(str(r.doc_id), r.text) for r in docs.collect()[:40]] + [("a", "x" * 300 + " ab  cd\n\n▁ é😀 " + "wort" * 30), ("b", "")]
    for dropout in (0.1, 0.4):
        e = piece_codec.Encoder(p, dropout, 11)
        for (key, text), got in zip(texts, e.many([t for _, t in texts], [k for k, _ in texts])):
            want = []
            for place, unit in enumerate(re.findall(r" *[^ \n▁]+| +|\n|▁", " " + text) if text else []):
                if unit in ("▁", "\n"):
                    want += [p.byte[b] for b in unit.encode()]
                    continue
                state = {"turn": piece_codec.mixed(xxhash.xxh64_intdigest(key, 11) + place & full), "left": None}

                def dropped():  # a geometric gap for each hash, as many candidates pass
                    if state["left"] is None:
                        u = piece_codec.mixed(state["turn"])
                        state["left"] = next((g for g in range(4096) if u >= int((1 - dropout) ** (g + 1) * 2**64)), 4096)
                        state["turn"] = state["turn"] + piece_codec.GOLDEN & full
                    if state["left"]:
                        state["left"] -= 1
                        return False
                    state["left"] = None
                    return True

                want += plain_segments(p, unit, dropped)
            assert got.tolist() == want


def test_parts_of_a_text_are_encoded_as_one(monkeypatch, docs):
    texts = [r.text or "" for r in docs.collect()[:30]]
    keys = [*map(str, range(30))]
    want = [x.tolist() for x in piece_codec.Encoder(piece_codec.pieces(None), 0.2, 3).many(texts, keys)]
    monkeypatch.setattr(piece_codec, "TOGETHER", 50)
    assert [x.tolist() for x in piece_codec.Encoder(piece_codec.pieces(None), 0.2, 3).many(texts, keys)] == want


def test_encoding_edges(spark, edges):
    assert piece_codec.encode(edges.limit(0)).count() == 0 and piece_codec.decode(piece_codec.encode(edges.limit(0))).count() == 0
    named = edges.select("doc_id", "text", F.lit("x").alias("pieces"), F.lit(1).alias("lossless"))
    assert piece_codec.encode(named, with_pieces=False).columns == ["doc_id", "n_pieces", "pieces_hash", "lossless"]


def planted(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    passage = [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    docs = []
    for d in range(60):
        before, after = " ".join(rng.choices(words, k=rng.randint(5, 80))), " ".join(rng.choices(words, k=rng.randint(5, 80)))
        docs.append((d, f"{before} {passage[d % 3]} {after}" if d % 2 else f"{before} {after}"))
    return docs, passage


def test_planted_passages_are_cut_and_clean_texts_stay(spark):
    docs, passage = planted(1)
    out = {r.r.doc_id: r for r in substring_dedup.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    owners = {next(d for d, t in docs if p in t) for p in passage}
    for d, t in docs:
        row = out[d]
        assert (row.repeated_words > 0) == bool(d % 2)
        assert (row.cut_words > 0) == (bool(d % 2) and d not in owners)
        if not row.cut_words:
            assert row.text == t
        else:
            left = [w for w in t.split() if w not in row.text.split()]
            assert row.n_words - row.cut_words == len(row.text.split()) and len(left) <= 60 and row.cut_words >= 30


def test_chunks_of_many_documents_are_no_passage(spark):
    """Every chunk of the last text is in some other document, but no 25 words in a row are."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    clean = [word() for _ in range(120)]
    docs = [(k, " ".join([*(word() for _ in range(20)), *clean[at : at + 20], *(word() for _ in range(20))])) for k, at in enumerate(range(0, 101, 3))]
    docs += [(1000, " ".join(clean)), (1001, " ".join(clean[30:90]))]
    out = {r.r.doc_id: r for r in substring_dedup.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not any(out[d].repeated_words for d, _ in docs[:-2])
    assert out[1000].text == docs[-2][1] and not out[1000].cut_words and 30 <= out[1000].repeated_words <= 60
    assert 30 <= out[1001].cut_words


def test_chunks_resist_insertions_and_rejoin():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdef", k=rng.randint(2, 8))) for _ in range(2000))
    a, b = substring_dedup.chunks(text), substring_dedup.chunks("new words here " + text)
    assert len(set(map(tuple, a[2].tolist())) & set(map(tuple, b[2].tolist()))) > 0.95 * len(a[0])
    assert a[0][-1] == len(text.encode()) and a[1].sum() == 2000
    assert substring_dedup.chunks("é" * 5000)[0][-1] == 10_000 and all(e % 2 == 0 for e in substring_dedup.chunks("é" * 5000)[0])


def test_chunks_without_white_space_resist_insertions(spark):
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(20_000))
    a, b = substring_dedup.chunks(text), substring_dedup.chunks("新的" + text)
    assert len(set(map(tuple, a[2].tolist())) & set(map(tuple, b[2].tolist()))) > 0.98 * len(a[0]) and len(a[0]) > 500
    text.encode()[: a[0][7]].decode()  # an end lies between characters
    passage = text[:300]
    rows = [(k, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)) + passage * (k % 2) + "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200))) for k in range(8)]
    out = {r.r.doc_id: r for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k].cut_words > 0 for k in range(8)] == [False, False, False, True, False, True, False, True]
    assert all(len(out[k].text) < 700 - 200 and out[k].text[:190] == rows[k][1][:190] for k in (3, 5, 7))


def plain_chunks(text):
    """Ends of chunks by a loop over the bytes."""
    raw, ends, last = text.encode(), [], 0
    gear = [substring_dedup.xxhash.xxh32_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)]
    white, run = b"\t\n\x0b\x0c\r ", 0
    hashes = [sum(gear[raw[i - j]] << j for j in range(min(16, i + 1))) & 0xFFFF for i in range(len(raw))]
    inner = lambda i: i + 1 < len(raw) and raw[i + 1] & 0xC0 == 0x80
    fit = []
    for i, b in enumerate(raw):
        run = 0 if b in white else run + 1
        fit.append((b in white and hashes[i] >> 14 == 0) or (run > 48 and not inner(i) and hashes[i] >> 13 == 0))
    for i in range(len(raw)):
        if not fit[i] and i + 1 < len(raw):
            continue
        while i + 1 - last > 256:
            may = [j for j in range(last + 15, last + 256) if raw[j] in white] or [j for j in range(last + 15, last + 256) if not inner(j)]
            last = min(may, key=lambda j: (hashes[j], -j)) + 1
            ends.append(last)
        if i + 1 - last >= 16 or i + 1 == len(raw):
            ends.append(i + 1)
            last = i + 1
    return ends


def test_chunks_equal_a_loop(docs):
    texts = [r.text or "" for r in docs.collect()[:40]] + ["the of " * 300, "x" * 1000, "é" * 700 + " ok " * 99, "", "a"]
    for text in texts:
        assert substring_dedup.chunks(text[:20_000])[0] == plain_chunks(text[:20_000])


def test_cuts_equal_all_pairs(spark):
    """Which words go, against spans that all pairs of documents are searched for."""
    docs, _ = planted(3)
    least, parts = substring_dedup.LEAST_WORDS, {}
    for d, text in docs:
        raw, ends = text.encode(), plain_chunks(text)
        parts[d] = [raw[i:j] for i, j in zip([0, *ends], ends)]

    def spans_of(chunks):
        n = [len(c.split()) for c in chunks]
        out = set()
        for i in range(len(chunks)):
            j = next((j for j in range(i + 1, len(chunks) + 1) if sum(n[i:j]) >= least), None)
            k = next((k for k in range(i, -1, -1) if sum(n[k : i + 1]) >= least), None)
            out |= ({(i, j)} if j else set()) | ({(k, i + 1)} if k is not None else set())
        return out

    held = {d: {tuple(parts[d][i:j]): (i, j) for i, j in spans_of(parts[d])} for d, _ in docs}
    out = {r.r.doc_id: r for r in substring_dedup.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, text in docs:
        gone = set()
        for span, (i, j) in held[d].items():
            if any(span in held[e] for e in held if e < d):
                gone |= set(range(i, j))
        assert out[d].text == b"".join(c for k, c in enumerate(parts[d]) if k not in gone).decode()


def test_rows_of_one_id_dont_repeat_each_other(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text), (1, text), (1, text + " and more"), (None, text + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(not r.repeated_words and not r.cut_words for r in substring_dedup.passages(docs.where("doc_id = 1")).collect())
    out = substring_dedup.passages(docs).collect()  # one without an id is a document of its own
    assert all(r.repeated_words > 25 for r in out) and {r.r.doc_id for r in out if r.cut_words} == {None}


def test_spans_that_share_a_digest_are_told_apart(spark):
    spans = spark.createDataFrame([(1, 5, 7), (2, 5, 8), (3, 5, 8), (3, 5, 8)], "id long, digest long, check int")
    assert [tuple(r) for r in substring_dedup.repeated_spans(spans).collect()] == [(5, 8, 2)]
    found = np.array([(5, 7), (5, 8), (6, 8)], substring_dedup.SPAN)
    assert substring_dedup.among(found, np.array([(5, 8)], substring_dedup.SPAN)).tolist() == [False, True, False]
    for rows in ([(5, 7), (6, 1), (5, 7)], [(5, 7), (5, 8), (5, 7)], []):
        assert sorted(substring_dedup.distinct(np.array(rows, substring_dedup.SPAN)).tolist()) == sorted(set(rows))


def test_sketches_that_share_a_name_keep_their_rows(spark):
    prints = spark.createDataFrame([(1, b"a", 9, b"x"), (2, b"b", 9, b"x"), (3, b"c", 9, b"y"), (None, b"d", 9, b"y"), (4, b"e", 8, b"z")], "id long, k binary, fp long, sketch binary")
    rest, odd = near_texts.told_apart(prints)
    kept = {r.id for r in rest.collect()}
    assert kept in ({1, 2, 4}, {3, None, 4}) and [bytes(r.odd_k) for r in odd.collect()] == ([b"c"] if 1 in kept else [b"a"])
    assert near_texts.told_apart(prints.where("id != 3"))[1] is None


def test_substring_edges(spark, edges):
    rows = substring_dedup.passages(edges).collect()
    assert len(rows) == len(EDGES) and all(r.text == r.r.text and not r.cut_words for r in rows)
    assert substring_dedup.passages(edges.limit(0)).count() == 0
    assert substring_dedup.deduplicated(edges).columns == edges.columns


def test_token_counts_equal_the_library(spark, docs, edges):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, edges):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        want = sorted((str(d), len(t.encode()), len(x.ids), len(x.ids) > 1024) for (d, t), x in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False)))
        assert sorted((str(r[0]), *r[1:]) for r in token_count.count_tokens(df).collect()) == want


def test_no_texts_have_no_counts(spark, edges):
    assert token_count.count_tokens(edges.limit(0)).count() == 0


def test_any_text_counts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    count, library, rng = token_count.counter(path), Tokenizer.from_file(path), random.Random(1)
    alphabet = ["a", "'s", " ", "  ", "\n", "é", "中", "😀", "1", "²", "!!", "\x1c", "\x85", "<|endoftext|>", "<|", "\xa0", "the"]
    for _ in range(3000):
        s = "".join(rng.choices(alphabet, k=rng.randint(0, 14)))
        assert count(s) == len(library.encode(s, add_special_tokens=False).ids)


def test_quality_on_held_out(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grades = quality_model.grades_of_labels(l)
    model = quality_model.fit(d, grades.where("doc_id % 4 <> 0"))
    assert (np.diff(model.thresholds) >= 0).all()
    out = quality_model.grade(d.where("doc_id % 4 = 0"), model).select("r.doc_id", "keep", "expected_grade").join(grades, "doc_id")
    share = {r.grade: (r.k, r.e) for r in out.groupBy("grade").agg(F.avg(F.col("keep").cast("int")).alias("k"), F.avg("expected_grade").alias("e")).collect()}
    assert share[2][0] > 0.97 and share[1][0] < 0.15 and share[2][1] > share[1][1] > share[0][1]


def test_quality_reads_whole_tokens(spark):
    tokens = quality_model.Tokens(30)
    a, b = (tokens.features("q" * 64 + tail)[0] for tail in ("Aa0", "0000"))
    assert set(a.tolist()) != set(b.tolist()) and quality_model.shape("q" * 64 + "A7") == "aA0"


def plain_grade(model, text):
    """A text's score and probabilities by loops over its tokens."""
    import xxhash

    bits, words, forms, tokens = model.settings.bits, set(), {}, text.split()
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    for t in tokens:
        core = " ".join(re.findall(r"[^\W\d_]+", t.lower()))
        if core:
            words.add(xxhash.xxh64_intdigest("w" + core) & ((1 << bits) - 1))
        form = re.sub(r"(?s)(.)\1+", r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in t))
        forms[form] = forms.get(form, 0) + 1
    score = sum(weight.get(w, 0.0) for w in words)
    for form, n in forms.items():
        score += weight.get((xxhash.xxh64_intdigest("s" + form) & ((1 << bits) - 1)) | 1 << bits, 0.0) * 4 * n / len(tokens)
    again = sum(x == y for x, y in zip(tokens, tokens[1:])) / (len(tokens) - 1) if len(tokens) > 1 else 0.0
    score += weight.get((2 << bits) + quality_model.REPEAT, 0.0) * 4 * again
    return score, [1 / (1 + np.exp(t - score)) for t in model.thresholds]


def test_grades_equal_a_loop(spark, docs):
    model = quality_model.fit(docs, quality_model.grades_of_labels(spark.read.parquet(f"{DATA}/labels.parquet")))
    for r in quality_model.grade(docs, model).collect():
        if r.r.text and r.r.text.strip():
            score, above = plain_grade(model, r.r.text)
            assert r.score == pytest.approx(score, abs=1e-9) and r.tail_probability == pytest.approx(above[-1], abs=1e-9)
            assert r.expected_grade == pytest.approx(sum(above), abs=1e-9)


def test_quality_edges(spark, edges):
    ratings = spark.createDataFrame([(5, 1), (8, 0), (None, 2), (7, None)], "doc_id long, grade int")
    rows = quality_model.grade(edges, quality_model.fit(edges, ratings)).collect()
    assert len(rows) == len(EDGES) and not any(r.keep for r in rows if r.r.doc_id in (1, 2, 3))
    assert quality_model.grade(edges, quality_model.fit(edges.limit(0), ratings.limit(0))).count() == len(EDGES)


def test_pipeline_stages(spark, docs, edges):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns and 0 < out.count()
        of_edges = stage(spark, edges, DATA)
        assert of_edges.columns == edges.columns and {r.doc_id for r in of_edges.collect()} <= {r[0] for r in EDGES}
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, edges, DATA).count() == len(EDGES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.run(spark, DATA).where("not lossless").count() == 0


def test_pipeline_against_brute_force(spark):
    """Which documents stay, stage by stage, on planted copies; the last stages against their own brute-force tests."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = stages["quality"](spark, docs, DATA).cache()
    model = quality_model.fit(docs, quality_model.grades_of_labels(spark.read.parquet(f"{DATA}/labels.parquet")))
    want = {r.doc_id for r in docs.collect() if r.text and r.text.strip() and plain_grade(model, r.text)[1][-1] >= 0.5}
    assert {r.doc_id for r in good.collect()} == want
    unlike = stages["near_copies"](spark, good, DATA).cache()
    assert {r.doc_id for r in unlike.collect()} == plain_owners([(r.doc_id, r.text) for r in good.orderBy("doc_id").collect()])
    cut = stages["repeated_passages"](spark, unlike, DATA).cache()
    mixed = stages["mix"](spark, cut, DATA)
    size = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0d]+", r.text))) for r in cut.collect()}
    words = defaultdict(int)
    for source, n in size.values():
        words[source] += n
    target, taken, largest = targets_by_rounds(words), defaultdict(int), max(n for _, n in size.values())
    for r in mixed.groupBy("doc_id").count().collect():
        assert r["count"] <= 3
        taken[size[r.doc_id][0]] += r["count"] * size[r.doc_id][1]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + largest for s in target)
    pieces = stages["encode"](spark, cut, DATA).collect()
    assert all(r.lossless for r in pieces) and len(pieces) == cut.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = QUERIES[name](spark, DATA)
    want = db.execute(ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert {tuple(r) for r in got.collect()} == {tuple(r[k] for k in at) for r in want.fetchall()}
