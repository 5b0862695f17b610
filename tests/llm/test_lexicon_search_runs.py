"""BPE by a lexicon, ranked lexical search and periodic runs: against the library, SQL and brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from episodica.llm import bpe_lexicon, lexical_search, period_runs
from episodica.llm.queries import QUERIES, looped_words

from test_llm_operators import DATA, DOCS, EDGES


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_lexicon.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_query_equals_the_library(spark, docs, library):
    got = {r.doc_id: r[1:] for r in QUERIES["op11_bpe_lexicon"](spark, DATA).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))


def test_bpe_edges(spark, edges, library):
    for most in (1 << 17, 3, 0):  # whatever is compiled, results are the same
        name = bpe_lexicon.compile_lexicon(edges, most=most)
        out = bpe_lexicon.decode(bpe_lexicon.encode(edges, name)).collect()
        assert len(out) == len(EDGES)
        by_id = {r.doc_id: r for r in out}
        for e in EDGES:
            assert np.frombuffer(by_id[e[0]].ids, "<u4").tolist() == library.encode(e[1] or "", add_special_tokens=False).ids
            assert by_id[e[0]].text == (e[1] or "")
    assert bpe_lexicon.encode(edges.limit(0)).count() == 0


def test_any_text_is_encoded_as_by_the_library(library):
    path = bpe_lexicon.default_vocabulary()
    tokens = bpe_lexicon.tokens_of(path)
    words = [" the", "ab", "\nab", " a'", "  b"]
    pieces = bpe_lexicon.splitter(path)[1]
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compiled([(w.encode(), np.frombuffer(b"".join(tokens.encode([p.encode() for p in pieces(w)])), "<u4").tolist()) for w in words]))
    encoder, decoder, draw = bpe_lexicon.Encoder(path, lexicon), bpe_lexicon.Decoder(tokens), random.Random(5)
    letters = "ab <|endoftext|>\n\t'sé中🙂1́\xa0\x1c\x1d\x85 　"
    texts = ["".join(draw.choice([draw.choice(letters), draw.choice(" \n'"), "<|endoftext|>", " the", chr(draw.randrange(1, 0xD800))]) for _ in range(draw.randint(0, 20))) for _ in range(2000)]
    texts += ["x" * 200 + " the" * 50, "ab" * 3000, " " * 500]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert decoder.decode(ids) == text
    for _ in range(500):  # ids of no text
        ids = [draw.randrange(50257) for _ in range(draw.randint(0, 5))]
        assert decoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert decoder.decode(np.array([10**6], "<u4").tobytes()) == ""


def test_automaton_is_minimal_and_numbers_its_words():
    draw = random.Random(2)
    for _ in range(50):
        words = sorted({bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(0, 40))})
        lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compiled([(w, [k]) for k, w in enumerate(words)]))
        assert lexicon.numbers(words).tolist() == list(range(len(words)))
        others = [bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 7))) for _ in range(50)]
        assert lexicon.numbers(others).tolist() == [words.index(w) if w in words else -1 for w in others]
        prefixes = {w[:k] for w in words for k in range(len(w) + 1)} | {b""}
        assert len(lexicon.final) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_pieces_merge_in_step_as_by_heap():
    tokens, draw = bpe_lexicon.tokens_of(bpe_lexicon.default_vocabulary()), random.Random(1)
    pieces = [bytes(draw.choice(b"abcethinor ") for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    assert tokens.encode(pieces) == [tokens.id_of[np.array(tokens._by_heap(p), int)].tobytes() for p in pieces]
    assert tokens.encode([]) == []


def plain_ranking(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: pattern.findall((t or "").translate(lower))
    found = [(i, of(t)) for i, t in docs]
    found = [(i, Counter(w), len(w)) for i, w in found if w]
    n_docs, n_terms, df = len(found), sum(n for _, _, n in found), Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c, n in found:
            m = 25 + (75 * n * n_docs) // n_terms
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in of(text) if c[t]), i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out, key=repr)


def test_ranking_equals_a_loop(spark, monkeypatch):
    draw = random.Random(4)
    words = ["the", "The", "cat", "é1", "x9", "中文", "ß", "dog-bird", "a_b", "\x1f"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(draw.randint(0, n)))
    rows = [(i, text(30)) for i in range(120)] + [(3, "cat cat"), (3, "cat cat"), (None, "cat cat"), (7, None), (8, ""), (500, "cat " * 30_000)] + [(600 + i, "x9 dog") for i in range(40)]
    items = [(i, text(6)) for i in range(12)] + [(12, "x9"), (12, "x9"), (12, "cat"), (13, None), (14, "unseen"), (None, "dog cat cat")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item_id int, score int")
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = plain_ranking(rows, items)
    got = lambda: sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.ranked(docs, asked).collect()], key=repr)
    assert got() == want
    for name, value in (("ENTRIES", 7), ("TERM_COLUMNS", 2), ("DOC_COLUMNS", 3), ("ITEM_ROWS", 2), ("EXACT", 1 << 33)):
        monkeypatch.setattr(lexical_search, name, value)
    assert got() == want
    assert lexical_search.ranked(docs.limit(0), asked).count() == lexical_search.ranked(docs, asked.limit(0)).count() == 0


def test_partial_sums_stay_exact():
    counts = np.array([[10**6, 3, 0], [5, 2**40, 7]], np.int64)
    most = np.array([30_000_000_000, 25_000, 10**6])
    parts = list(lexical_search.exact_tiles(counts, most, np.arange(3)))
    total = np.zeros_like(counts)
    for columns, q in parts:
        assert (q @ most[columns].astype(float)).max() < lexical_search.EXACT
        total[:, columns] += q.astype(np.int64)
    assert (total == counts).all()


def plain_runs(words):
    """All runs by comparing the words with themselves at every distance."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            z = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - z + q >= max(12, 2 * q):
                out.setdefault((z - q, i), q)
            i += 1
    return sorted((a, z - a, q) for (a, z), q in out.items())


def repeating_words(draw):
    n = draw.randint(0, 90)
    words = [draw.randrange(draw.choice([1, 2, 3, 5, 20])) for _ in range(n)]
    for _ in range(draw.randint(0, 3) if n > 3 else 0):
        a = draw.randrange(n)
        p = draw.randint(1, max(1, (n - a) // 2))
        part = words[a : a + p * draw.randint(1, 5)]
        words[a : a + len(part)] = [part[k % p] for k in range(len(part))]
    return words


def test_runs_equal_brute_force(monkeypatch):
    draw = random.Random(1)
    for _ in range(3000):
        words = repeating_words(draw)
        want = plain_runs(words)
        assert period_runs.runs_of(words) == want
        catchers, at, text = period_runs.Catchers(), 0, "".join(map(chr, words))
        while at < len(words):  # appended bit by bit, the same runs are caught
            more = draw.randint(1, 9)
            catchers.append(text[at : at + more])
            at += more
        assert catchers.runs() == want
        with monkeypatch.context() as m:  # as with more different words than characters
            m.setattr(period_runs, "CODES", 1)
            assert period_runs.runs_of(words) == want


def test_runs_query_equals_a_loop(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op13_period_runs"](spark, DATA).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    looped = 0
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            looped += 1
        runs = plain_runs(words) if n <= 3000 else period_runs.runs_of(words)
        r = got[doc_id]
        best = min(((-length, start, q) for start, length, q in runs), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == sha("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode())
        gone = {i for a, m, q in runs for i in range(a + q, a + m)}
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode())
    assert looped


def test_runs_edges(spark, edges):
    rows = [r.asDict(True) for r in period_runs.find_runs(edges).collect()]
    assert len(rows) == len(EDGES)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == by_id[3]["n_words"] == 0 and by_id[1]["collapsed"] == "" and by_id[1]["runs"] == []
    assert by_id[8]["runs"] == [{"start": 0, "length": 60_000, "period": 1}] and by_id[8]["collapsed"] == "wort"
    assert by_id[None]["collapsed"] == "the cat sat" and by_id[6]["n_words"] == 1
    assert period_runs.find_runs(edges.limit(0)).count() == 0
    assert looped_words(None, [b"a"]) == [b"a"] and looped_words(5, []) == []
    odd = spark.createDataFrame([(1, "a\x1cb c " * 12)], "doc_id long, text string")  # only white space of ASCII parts words
    assert period_runs.find_runs(odd).first().runs[0].asDict() == {"start": 0, "length": 12, "period": 1}
