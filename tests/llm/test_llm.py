"""The training-data operators against brute force, on small planted tables and on the smallest scale."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm import ann, encoding, exact_dedup, language_id, license_scan, mixing, packing, queries, simhash, substring_dedup, token_counts, token_store
from claimloom.llm.common import local_file, scratch_path
from claimloom.llm.encoding import PieceEncoder

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from test_reference import SF, same_rows  # noqa: E402

BPE = local_file("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, len long, id long"
WORDS = "the of and sun moon river stone house Tür für und das ist à été une".split()


def planted():
    """Nulls, empties, ties, repeated rows, white space only, long texts and near copies; columns named as the operators' own."""
    rng = random.Random(3)
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(400))
    texts = [None, "", " ", "\n\t", "a", "a b", "A  B", base, base, base + " end", base.replace(" ", "\n", 3), "x" + base, "Released under the MIT License. x\nAll rights reserved.", "<|endoftext|> 12", "é" * 3000, " ".join([base] * 30)]
    rows = [(i, t, "en" if i % 3 else None, ["a", "b", None][i % 3], 0, "w", 1, 7) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[9], (None, "a b", None, None, 0, "w", 1, 7), (5, "other text of id five", "en", "a", 0, "w", 1, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(planted(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    same_rows(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_encoder_equals_library():
    tok, rng = Tokenizer.from_file(BPE), random.Random(5)
    parts = ["a", "é", "B", " ", "  ", "\n", "\n\n", "\t", "\r", "'s", "<|endoftext|>", "19", "...", "​", "￾", "￿", "\x85", "\xa0", "　", "漢", "🙂", " the", "\x1c", "\x00"]
    for enc in (PieceEncoder(BPE), PieceEncoder(BPE, 50)):
        for _ in range(60):
            texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(30)]
            want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
            assert [x.tolist() for x in enc.encode(texts)] == want
            assert enc.count(texts) == [len(x) for x in want]


def test_language_id(spark, docs, empty):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the river", "en"), ("das Haus und der Fluss ist für", "de"), ("дом и река", "ru")] * 20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, "the house and the river the house"), (2, "река и дом река"), (3, None), (4, "12 .. 3"), (5, "the house and the river and the house das Haus und der Fluss ist für und das Haus und der Fluss"), (5, "the river")]
    got = language_id.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["en", "ru", "und", "und", "de", "en"]
    assert got[2].score == 0 and 0 < got[4].score < 1
    assert [s.lang for s in got[4].spans] == ["en", "de"]
    marks = [(1, "\u2764\ufe0f 12"), (2, "1\ufe0f\u20e3"), (3, "\u0301"), (4, "te\u0301 house"), (5, "the house " * 40_000), (6, "42")]
    got = language_id.predict(spark.createDataFrame(marks, "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score > 0) for r in got] == [("und", False)] * 3 + [("en", True)] * 2 + [("und", False)]
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.predict(docs, language_id.fit(empty))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and nothing.count() == len(planted())


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    scores, owner = rng.normal(0, 3, (9, 3)).astype(np.float32), np.array([0, 0, 0, 0, 1, 3, 3, 3, 3])
    got = language_id.viterbi(scores, owner, 4, 2.0)
    for t in (0, 1, 3):
        own = scores[owner == t].astype(float)
        total = lambda path: sum(own[i, s] for i, s in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=len(own)), key=total)
        assert total(got[owner == t].tolist()) == pytest.approx(total(best))


def test_language_held_out_accuracy(spark):
    found = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.9


def test_neighbours(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    got = defaultdict(list)
    for r in queries.op2_nearest_neighbours(spark, SF).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in (q for q in rows if q % 50 == 0):
        cos = sorted(((-float(rows[q] @ v / np.sqrt((rows[q] @ rows[q]) * (v @ v))), i) for i, v in rows.items() if i != q))[:5]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        hits += len({i for _, i in cos} & {i for _, i, _ in mine})
        total += 5
        assert all(s == pytest.approx(float(rows[q] @ rows[i] / np.sqrt((rows[q] @ rows[q]) * (rows[i] @ rows[i]))), abs=1e-12) for _, i, s in mine)
    assert hits >= 0.9 * total
    odd = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [0.0, 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (7, [0.0, 1.0], 1)]
    frame = spark.createDataFrame(odd, "vec_id long, embedding array<double>, rank int")
    near = [(r["rank"], r.vec_id, r.score) for r in ann.search(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert near == [(1, 1, 1.0), (2, 2, 1.0), (3, 7, 0.0)]
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


def test_token_counts(spark, docs, empty):
    tok = Tokenizer.from_file(BPE)
    want = Counter((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in planted())
    got = token_counts.count_tokens(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(empty).count() == 0
    text = "one two  three four\n" * 4000
    assert "".join(token_counts.split_safely(text, 1000)) == text and len(token_counts.split_safely(text, 1000)) > 50
    assert token_counts.count_texts(BPE, [text]) == [len(tok.encode(text).ids)]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        assert token_counts.count_tokens(docs, name).count() == len(planted())


def test_a_full_cache_keeps_the_pieces_met_again():
    tok, enc = Tokenizer.from_file(BPE), PieceEncoder(BPE, 40)
    for i in range(30):
        text = " ".join(["the river  is\n19", *(f"w{i}x{j}" for j in range(10))])
        assert enc.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert "river" in enc.number and len(enc.number) < 100 and len(enc.ends) == len(enc.unsafe) + 1 == len(enc.number) + 1


def test_token_store(spark, docs, empty):
    tok = Tokenizer.from_file(BPE)
    streams = sorted(((-1 if r[0] is None else r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in planted()), key=lambda x: x[0])
    path = scratch_path(spark, "t")
    token_store.write_store(docs, path)
    got = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [d for d, _ in streams]
    assert all(r.verified for r in got) and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    crc = Counter((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in streams)
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == crc
    assert Counter((-1 if r.doc_id is None else r.doc_id, *r.ids) for r in token_store.read_documents(spark, path).collect()) == Counter((d, *ids) for d, ids in streams)
    chunks = spark.read.parquet(f"{path}/parts").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count() < spark.read.parquet(f"{path}/recipes").select(F.sum(F.length("digests") / 16)).first()[0]
    path = scratch_path(spark, "t")
    token_store.write_store(empty, path)
    assert token_store.read_digests(spark, path).count() == 0


def test_token_store_holds_small_batches_and_one_stage_s_cache(spark, monkeypatch, tmp_path):
    seen, encode, key = tmp_path / "seen", token_store._encode_parts, "spark.sql.execution.arrow.maxBytesPerBatch"

    def noting(*args):
        def run(batches):
            def each():
                for batch in batches:
                    with open(seen, "a") as f:
                        f.write(f"{batch.nbytes}\n")
                    yield batch

            return encode(*args)(each())

        return run

    monkeypatch.setattr(token_store, "_encode_parts", noting)
    before = spark.conf.get(key)
    token_store.write_store(spark.range(0, 6_000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 400) AS text"), scratch_path(spark, "t"))
    sizes = [int(x) for x in seen.read_text().split()]
    assert sum(sizes) > 12 << 20 and max(sizes) < 6 << 20 and spark.conf.get(key) == before
    for later in (token_store._once, token_store._check_chunks, token_store._open_recipes):
        encoding.encoder(BPE)
        assert list(later([])) == [] and not encoding._encoders


def test_cuts_depend_on_nearby_ids_only():
    ids = np.random.default_rng(1).integers(0, 50_000, 60_000).astype(np.uint16)
    cuts = lambda x: token_store.cut_points(len(x), token_store.cut_candidates(x).tolist())
    a, b = cuts(ids), cuts(np.concatenate([ids[:7], ids]))
    assert len({x - 60_000 for x in a} & {x - 60_007 for x in b}) > 0.9 * len(a)


def test_chunks_of_streams_in_a_row_and_streamed_roots():
    """Streams in a row are cut as each alone; a root of leaves that come one by one is the whole tree's."""
    rng = np.random.default_rng(6)
    streams = [rng.integers(0, 50_000, n).astype(np.uint16) for n in (0, 1, 3000, 20, 9000, 130)]
    row, stops = token_store.cut_candidates(np.concatenate(streams)), np.cumsum([len(s) for s in streams])
    for s, stop in zip(streams, stops.tolist(), strict=True):
        own = row[(row > stop - len(s)) & (row <= stop)] - (stop - len(s))
        assert token_store.cut_points(len(s), own.tolist()) == token_store.cut_points(len(s), token_store.cut_candidates(s).tolist())
    for n in range(20):
        leaves, tree = [bytes([i]) for i in range(n)], token_store.MerkleStack()
        for leaf in leaves:
            tree.add(leaf)
        assert tree.root() == token_store.merkle_root(leaves)


def test_substring_dedup(spark, docs, empty, monkeypatch):
    rng = random.Random(9)
    shared = " ".join(f"s{rng.randrange(99)}" for _ in range(60))
    rows = [(r[0], r[1]) for r in planted()] + [(100 + i, " ".join([*(f"u{i}_{k}" for k in range(i)), shared, "tail"])) for i in range(40)] + [(200, shared.replace(" ", "  \n")), (201, " ".join(shared.split()[:12]))]
    first = {}
    lists = [(-(1 << 63) if d is None else d, words(t)) for d, t in rows]
    for d, w in lists:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    want = Counter()
    for (d, w), (own, _) in zip(lists, rows, strict=True):
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(13)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        want[own, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(r.n_removed == sum(s.until - s.first for s in r.spans) for r in got)
    assert substring_dedup.remove_repeats(empty).count() == 0
    # a partition cut into many parts, repeated and null ids among the rows, and clashing names give the same
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 200)
    monkeypatch.setattr(substring_dedup, "MOST_PARTITIONS", 2)
    assert substring_dedup._layout(4, 10_000) == (4, 13) and substring_dedup._layout(1, 0) == (1, 1) and substring_dedup._layout(1, 10_000) == (2, 25)
    more = spark.createDataFrame([(*r, 7, 8, "x") for r in rows], "doc_id long, text string, `to` int, part int, payload string")
    cut = substring_dedup.remove_repeats(more).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in cut) == want


def test_licenses(spark, docs, empty):
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert list(got[12].licenses) == ["MIT", "proprietary"] and list(got[12].sentence_ids) == ["mit-notice", "all-rights-reserved"]
    assert got[0].n_licenses == 0 and license_scan.scan_licenses(docs).count() == len(planted()) and license_scan.scan_licenses(empty).count() == 0
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice"]
    pair = spark.createDataFrame([(1, ". ".join(bsd)), (2, ". ".join(bsd[::-1]))], "doc_id long, text string")
    assert [list(r.licenses) for r in license_scan.scan_licenses(pair).orderBy("doc_id").collect()] == [["BSD-2-Clause"], []]


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE_TEXT = """# Copyright 2020 Some One. All rights reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
GPL_TEXT = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD_TEXT = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"""


def test_license_texts(spark):
    """Verbatim and wrapped, with line ends of Windows, on one line; a notice among wrapped lines; a bare reservation of rights."""
    texts = {"MIT": MIT_TEXT, "Apache-2.0": APACHE_TEXT, "GPL-3.0": GPL_TEXT, "BSD-2-Clause": BSD_TEXT}
    rows = [(name, f(t)) for name, t in texts.items() for f in (str, lambda t: t.replace("\n", "\r\n"))]
    rows += [(name, re.sub(r"\s+", " ", t)) for name, t in texts.items() if name not in ("Apache-2.0", "GPL-3.0")]
    rows += [("proprietary", "Copyright 2020\nAll rights reserved\nno more"), ("MIT", "see below\nReleased under the MIT License\nand more text")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, list(r.licenses)) for r in got] == [(name, [name]) for name, _ in rows]


def test_license_long_lines_and_longer_rules(spark):
    """A known sentence behind any number of signs; a text of three clauses is not one of two."""
    three = BSD_TEXT.replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS")
    rows = [("MIT", "Released under the MIT License" + "!" * 5000), ("BSD-3-Clause", three)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, list(r.licenses)) for r in got] == [(name, [name]) for name, _ in rows]


def test_language_of_many(spark):
    """More languages than a byte counts."""
    names = [f"l{k:03}" for k in range(300)]
    model = language_id.Model(names, np.zeros((language_id.GRAMS, 300), np.float32), np.ones((len(language_id.SCRIPTS) + 1, 300), bool))
    model.logp[:, 290] = 1.0
    got = language_id.predict(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), model).first()
    assert got.lang_pred == "l290" and got.score == 1


def check_packing(rows, pieces, cap=1024):
    tok = Tokenizer.from_file(BPE)
    want = Counter()
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % cap or cap
        for n, a in enumerate([0, *range(first, len(ids), cap)]):
            own = ids[a : a + cap] if n else ids[:first]
            want[d, n, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap
    return len(bins), sum(r.length for r in pieces)


def test_packing(spark, docs, empty):
    check_packing([(r[0], r[1]) for r in planted()], packing.pack_documents(docs).collect())
    assert packing.pack_documents(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bins, total = check_packing(rows, queries.op7_best_fit_packing(spark, SF).collect())
    assert bins <= 1.02 * -(-total // 1024)


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    lens = rng.integers(1, 1024, 300).tolist()
    people = []
    for _ in range(2):
        person = ([], [])
        packing.best_fit(rng.permutation(300).tolist(), lens, 1024, *person)
        people.append(person)
    bins, free = packing.crossover(*people, lens, 1024, rng)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all(1024 - sum(lens[i] for i in b) == f >= 0 for b, f in zip(bins, free, strict=True))


def test_evolution_saves_bins():
    """Lengths of which best fit leaves room: generations need fewer bins than the best seed, and keep every piece within its bin."""
    rng, seeds, elites = np.random.default_rng(0), 0, 0
    for _ in range(4):
        lens = rng.integers(200, 500, 300)
        seed, best = (packing.evolve(lens, 1024, [], 1, pieces)[0] for pieces in (0, packing.LAST_GENERATION_PIECES))
        assert len(best) == 300 and np.bincount(best, lens).max() <= 1024
        seeds, elites = seeds + seed.max() + 1, elites + best.max() + 1
    assert elites <= 0.98 * seeds


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in planted():
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_names, left = {}, list(names), Fraction(sum(sizes.values()))
    while open_names:
        share = {s: left * weight[s] / sum(weight[x] for x in open_names) for s in open_names}
        over = [s for s in open_names if share[s] > 3 * sizes[s]]
        target |= {s: Fraction(3 * sizes[s]) for s in over} if over else share
        left -= sum(target[s] for s in over)
        open_names = [s for s in open_names if s not in over] if over else []
    source = {r[0]: r[3] for r in planted() if r[0] != 5}
    for r in got:
        if r.doc_id in source:
            assert r.target == pytest.approx(float(target[source[r.doc_id]])) and r.source_size == sizes[source[r.doc_id]]
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
    assert len(got) == len(planted()) and sorted(mixing.mix(docs.repartition(3)).collect(), key=str) == sorted(got, key=str)
    assert mixing.mix(empty).count() == 0
    own = queries.op8_source_mixing(spark, SF).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= max(2 * r.most, 0.05 * r.target) for r in own)


def test_exact_dedup(spark, docs, empty):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for r in planted():
        groups[norm(r[1])].append(r[0])
    for hash_all in (False, True):
        got = exact_dedup.exact_groups(docs, hash_all=hash_all).collect()
        low = lambda ids: None if None in ids else min(ids)
        want = Counter((d, low(ids), len(ids)) for t, ids in groups.items() for d in ids)
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        if hash_all:
            assert {r.full_hash for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    assert exact_dedup.exact_groups(empty).count() == 0


def fingerprint(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=3):
    label = {f: f for f in fps}
    for _ in label:
        new = {f: min(label[g] for g in label if (f ^ g).bit_count() <= radius) for f in label}
        if new == label:
            break
        label = new
    return label


def test_simhash(spark, docs, empty):
    rng = random.Random(1)
    near = [rng.getrandbits(64) for _ in range(5)]
    pool = sorted({f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in near for _ in range(40)})
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in pool], "fp long")
    links = simhash.tile_links(signed, len(pool))
    label, unsigned = components(pool), lambda x: x % (1 << 64)
    got = defaultdict(set)
    for r in simhash.components(links).collect():
        got[unsigned(r.label)].add(unsigned(r.node))
    want = defaultdict(set)
    for f in pool:
        want[label[f]].add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)

    rows = planted()
    label = components({fingerprint(r[1]) for r in rows})
    least = {}
    for r in rows:
        if r[0] is not None:
            k = label[fingerprint(r[1])]
            least[k] = min(least.get(k, r[0]), r[0])
    found = simhash.near_groups(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == Counter((r[0], f"{fingerprint(r[1]):016x}", least[label[fingerprint(r[1])]]) for r in rows)
    assert sum(r.kept for r in found) == len(set(label.values())) and all(r.doc_id == r.component_id for r in found if r.kept)
    assert simhash.near_groups(empty).count() == 0


def test_pipeline_drops_similar_texts(spark):
    """Random texts with changed words against the 5-word Jaccard of all pairs; a group of copies of copies; unlike texts stay."""
    import corpus_pipeline as cp

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(50_000)}"
    texts = []
    for n, changes in ((100, 1), (300, 5), (1000, 5), (1000, 20), (40, 3), (12, 1), (6, 1), (3, 1)):
        for _ in range(12):
            base = [word() for _ in range(n)]
            other = list(base)
            for i in rng.sample(range(n), changes):
                other[i] = word()
            texts += [" ".join(base), " ".join(other)]
    base = [word() for _ in range(140)]
    for _ in range(60):
        at = rng.randrange(140)
        texts.append(" ".join([*base[:at], word(), *base[at + 1 :]]))
    texts += [" ".join(base[:20]), None, "", " "]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    sets = [shingles(words((t or "").lower())) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                old, new = sorted((label[i], label[j]))[::-1]
                label = [new if x == old else x for x in label]
    table = spark.createDataFrame([(i, t, "en", "a", 0, "w", 1, 7) for i, t in enumerate(texts)], SCHEMA)
    got = cp.drop_near_copies(spark, table, SF)
    assert got.columns == table.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(label))


def test_xxh64_of_all_lengths():
    buf = bytes(random.Random(4).randrange(256) for _ in range(700))
    sizes = np.arange(0, 300)
    starts = np.arange(300) % 50
    want = [xxhash.xxh64_intdigest(buf[a : a + n], 42) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    assert simhash.xxh64_slices(buf, starts, sizes).tolist() == want


def test_pipeline_stages(spark, docs, empty):
    """Repeated rows and ids, nulls and extra columns: each stage on what its predecessor kept."""
    import corpus_pipeline as cp

    letters = lambda t: any(c.isalpha() for c in t or "")
    fitted = docs.filter("source = 'a'").withColumn("text", F.lit("the of and sun moon river stone house")).withColumn("lang", F.lit("en"))
    for table in (docs, docs.union(fitted.withColumn("doc_id", F.col("doc_id") + 1000))):
        before = [tuple(r) for r in table.collect()]
        one = cp.identify_languages(spark, table, SF)
        assert one.columns == docs.columns and {r.doc_id for r in one.collect()} <= {r[0] for r in before if letters(r[1])}
    one = one.cache()
    assert {r.doc_id for r in one.filter("source = 'a' AND doc_id >= 1000").collect()} == {r[0] for r in before if r[0] is not None and r[0] >= 1000}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    two = cp.drop_exact_copies(spark, docs, SF).collect()
    assert sorted(norm(r.text) for r in two) == sorted({norm(r[1]) for r in planted()})
    three = cp.drop_near_copies(spark, docs, SF).collect()
    assert len(three) == len(set(components({fingerprint(r[1]) for r in planted()}).values()))
    clashing = docs.withColumns({c: F.lit(c) for c in ("copies", "rows", "number", "row_key", "copy", "row", "key", "at", "part", "size", "tie")})
    for stage in (f for _, f in cp.STAGES[:-1]):
        assert stage(spark, clashing, SF).columns == clashing.columns and all(r["copies"] == "copies" and r["row"] == "row" for r in stage(spark, clashing, SF).collect())
    four = cp.mix_sources(spark, docs, SF)
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
    assert Counter(r.doc_id for r in four.collect()) == Counter({r.doc_id: r.n for r in taken}) and four.columns == docs.columns
    five = cp.pack_sequences(spark, docs, SF)
    check_packing([(r[0], r[1]) for r in planted()], five.collect())
    for stage in (f for _, f in cp.STAGES):
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_on_the_smallest_scale(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_packing(want, cp.run(spark, SF).collect())


def test_shortlists_are_bounded_at_any_size(spark):
    """A query gets PARTS shortlists whatever the vectors, and recall over all of them holds."""
    rng = np.random.default_rng(3)
    found = {}
    for n in (9000, 27000):
        x = rng.normal(size=(n, 16)).astype(np.float32)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = defaultdict(set)
        for r in ann.search(frame, F.col("vec_id") % 900 == 0).collect():
            got[r.query_id].add(r.vec_id)
        unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float64)
        hits = sum(len(got[q] & set(np.argsort(-np.where(np.arange(n) == q, -2, unit @ unit[q]))[:5].tolist())) for q in range(0, n, 900))
        found[n] = hits / (5 * len(range(0, n, 900)))
    assert min(found.values()) >= 0.9
    books = ann.fit_books(unit[:500], 4, 16)
    import pyarrow as pa

    table = pa.table({"rep": np.arange(n), "vector": [v.tolist() for v in unit]})
    blocks = list(ann._encode_blocks(books)(table.to_batches(max_chunksize=10_000)))
    state = pa.table({"at": pa.array([None], pa.int64()), "ids": [np.arange(3).tobytes()], "vectors": [unit[:3].tobytes()], "codes": pa.array([None], pa.binary()), "norms": pa.array([None], pa.binary())})
    streams = defaultdict(list)
    for b in blocks:
        streams[b.column("part")[0].as_py()].append(pa.table({"at": b.column("at"), "ids": b.column("ids"), "vectors": pa.array([None], pa.binary()), "codes": b.column("codes"), "norms": b.column("norms")}))
    sent = [r.num_rows for own in streams.values() for r in ann._score_blocks(books, 50)(pa.concat_tables([state, *own]).to_batches())]
    assert len(streams) == ann.PARTS and sum(sent) == ann.PARTS * 3 * 50


def test_nearest_within_tight_clusters_and_in_many_dimensions(spark):
    """clusters far tighter than the codewords tell apart, and 256 components without structure."""
    rng = np.random.default_rng(5)
    tight = rng.normal(size=(6, 64))[rng.integers(6, size=6000)] + 1e-4 * rng.normal(size=(6000, 64))
    for x in (tight, rng.normal(size=(6000, 256))):
        x = x.astype(np.float32).astype(np.float64)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        found = {(r.query_id, r.vec_id) for r in ann.search(frame, F.col("vec_id") % 300 == 0).collect()}
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        scores = unit[::300] @ unit.T
        scores[np.arange(20), np.arange(20) * 300] = -2
        want = {(300 * q, int(v)) for q, own in enumerate(scores) for v in np.argsort(-own)[:5]}
        assert len(found & want) >= 0.98 * len(want)


def test_a_full_block_gets_more_than_a_few_children():
    """two children of a block of 16,384 pieces left most of what the generations can do."""
    lens = np.clip(np.random.default_rng(0).lognormal(5.9, 0.5, packing.BLOCK), 2, 1023).astype(np.int32)
    few, whole = (packing.evolve(lens, 1024, [], 3, *pieces)[0].max() for pieces in ((2 * packing.BLOCK,), ()))
    assert whole <= few - 4
