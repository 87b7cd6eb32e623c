"""Spelling variants, exact top-k and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import lexical, queries, spelling, topk
from test_llm import SCHEMA, SF, planted


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(planted(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near(a, b):
    """One insertion, deletion or replacement, by trying every place."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    want = {}
    for word, n in counts.items():
        around = [w for w in counts if near(word, w)]
        form = min(around, key=lambda w: (-counts[w], w), default=None)
        form = form if form and counts[form] >= 5 * n else None
        want[word] = [n, len(around), form, counts[form] if form else None]
    for word, row in want.items():
        root = word
        while want[root][2]:
            root = want[root][2]
        row.append(root)
    return want


def contract_words(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def as_dict(frame):
    rows = frame.collect()
    found = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_variants(contract_words(rows))
    assert as_dict(queries.op11_spelling_variants(spark, SF)) == want and len(want) > 100


def test_spelling_of_planted_words(spark, docs, empty):
    rng = random.Random(4)
    letters, words = "abÀñ", set()
    while len(words) < 300:
        words.add("".join(rng.choice(letters) for _ in range(rng.choice((6, 6, 7, 7, 8)))))
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "zzabcd", "zabcdz", "abcdzz", "ab" * 400, "ab" * 399 + "a"}
    texts = [(i % 7, " ".join([w] * rng.choice((5, 5, 6, 25, 30, 125, 130, 700)))) for i, w in enumerate(sorted(words))]
    texts += [(None, "zzabcd"), (1, None), (2, ""), (3, "12 ..")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n int, word string")
    counts = Counter(w for _, t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    want = brute_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert as_dict(spelling.spelling_variants(frame)) == want
    assert any(want[row[2]][2] for row in want.values() if row[2])  # chains occur
    assert spelling.spelling_variants(empty).count() == 0
    lower = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for r in planted() for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""))
    assert as_dict(spelling.spelling_variants(docs)) == brute_variants({w: n for w, n in lower.items() if len(w) >= 6 and n >= 5})


def brute_top(rows, is_query, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    want = Counter()
    for q, qv in rows:
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q)[:k]
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(best, 1))
    return want


def top_rows(frame):
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("size", [1.0, 3e4, 1e5])
def test_top_k_against_brute_force(spark, monkeypatch, size):
    """Ties, copies and small blocks; components so large that sums need longs, too."""
    rng = random.Random(6)
    vectors = [[round(rng.gauss(0, 1), 1) * size for _ in range(3)] for _ in range(40)]
    rows = [(i, rng.choice(vectors)) for i in range(300)] + [(i, vectors[0]) for i in range(300, 420)]
    rows += [rows[0], rows[5], (5, vectors[1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    want = brute_top([(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i != 5], lambda i: i % 7 == 0, 10)
    got = top_rows(topk.search(frame.filter("vec_id <> 5"), F.col("vec_id") % 7 == 0, k=10))
    assert got == want
    both = topk.search(frame, F.col("vec_id") == 5, k=3).count()
    assert both == 6  # an id with two vectors is two queries


def test_top_k_of_odd_rows(spark):
    odd = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0]), (8, []), (9, [1e200, 1.0])]
    frame = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    assert top_rows(topk.search(frame, F.col("vec_id") == 0)) == Counter([(0, 1, 5, 0), (0, 2, 7, -1024 * 1024)])
    assert topk.search(frame.limit(0), F.lit(True)).count() == 0 == topk.search(frame, F.col("vec_id") == 99).count()
    assert topk.search(frame.filter("vec_id = 0"), F.lit(True)).count() == 0


def brute_ranks(docs, items, k=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    terms = [(i, Counter(split(t))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    want = Counter()
    for item, text in set(items):
        asked, found = Counter(split(text)), []
        for i, c in terms:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            found += [(-score, i is None, i, score)] if score > 0 else []
        want.update((item, rank, i, s) for rank, (_, _, i, s) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1))
    return want


@pytest.mark.parametrize(("shard_bytes", "rows"), [(1 << 20, 10**6), (2000, 0)])
def test_ranked_search_against_brute_force(spark, docs, empty, monkeypatch, shard_bytes, rows):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "STRIDE", 2)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    texts = [(r[0], r[1]) for r in planted()] + [(i, " ".join(random.Random(i).choices("Sun moon,river! stone ÉTÉ été 12 a".split(), k=i % 9))) for i in range(100, 300)]
    items = [(1, "moon River the"), (2, "été ÉTÉ stone stone"), (3, None), (4, "..."), (5, "absent"), (1, "moon River the"), (6, "a b x"), (6, "sun"), (None, "12 sun"), (7, " ".join(f"house{i}" for i in range(40)))]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in texts], "doc_id long, text string, n int, term string").repartition(3)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, weight int")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(frame, asked, shard_bytes=shard_bytes, broadcast_rows=rows).collect())
    assert got == brute_ranks(texts, items)
    assert lexical.search(empty, asked).count() == 0 == lexical.search(docs, asked.limit(0)).count()


def test_blocks_below_the_threshold_stay_packed():
    """Of a list with a few large impacts only the blocks that can reach the best ten are unpacked."""
    rng = np.random.default_rng(2)
    docs = np.sort(rng.choice(100_000, 20_000, replace=False))
    impact = rng.integers(1, 1000, len(docs))
    impact[4000:4010] += 100_000
    data, at = [], [0]
    for lo in range(0, len(docs), lexical.BLOCK):
        own = docs[lo : lo + lexical.BLOCK]
        data.append(lexical.pack_numbers(np.stack([np.diff(own, prepend=0), impact[lo : lo + lexical.BLOCK]], 1).reshape(-1))[0])
        at.append(at[-1] + len(data[-1]))
    last = np.array([docs[min(lo + lexical.BLOCK, len(docs)) - 1] for lo in range(0, len(docs), lexical.BLOCK)], np.int32)
    most = np.maximum.reduceat(impact, np.arange(0, len(docs), lexical.BLOCK)).astype(np.int32)
    own = lexical.Postings(last.tobytes(), most.tobytes(), np.array(at[:-1], np.int32).tobytes(), np.concatenate(data).tobytes())
    found, scores = lexical.best_of_shard([(own, 3)], 10)
    assert scores.tolist() == sorted((3 * impact[4000:4010]).tolist(), reverse=True) and set(found) == set(docs[4000:4010])
    assert len(own.blocks) <= 3 < len(last)


def test_numbers_survive_packing():
    values = np.r_[0, 1, 127, 128, 16383, 16384, 10**6, 2**31, 2**40, np.random.default_rng(1).integers(0, 2**21, 5000)]
    data, at = lexical.pack_numbers(values)
    assert lexical.unpack_numbers(data).tolist() == values.tolist()
    assert lexical.unpack_numbers(data[at[7] :])[0] == 2**31 and len(lexical.unpack_numbers(data[:0])) == 0
