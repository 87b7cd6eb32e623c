"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional codeword from each of M codebooks. Codebooks are fitted on
residuals, then all at once by least squares; codes are found by beam search. What the codewords leave,
however much that is on other data or in more dimensions, is one more term of a byte a component with a
scale of the vector's own. A block of codes is summed up once for many queries and scored by the cosine
to the sum; the best are reranked by the exact cosine of the original vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, splitmix

#: Vectors that the codebooks are fitted on, at most, drawn by a hash of the id; the bound doesn't grow.
SAMPLE = 16_384
BOOKS, WORDS, BEAM, ROUNDS = 24, 64, 8, 2
#: Distinct vectors of each query that are scored exactly; queries in a block, and at once; codes in a block.
SHORTLIST, QUERY_BLOCK, QUERY_SLICE, CODE_BLOCK = 300, 4096, 1024, 4096
#: Streams that the codes are dealt to for each query block, so a query has so many shortlists at any size.
PARTS = 8


def _kmeans(x: np.ndarray, k: int, rng, steps: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        for j in range(k):
            own = x[near == j]
            centres[j] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes [n, M] of vectors by beam search: the partial sums nearest so far stay in the beam."""
    m_books, k, d = books.shape
    x, books = x.astype(np.float32), books.astype(np.float32)
    out = np.empty((len(x), m_books), np.int64)
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        n = len(part)
        codes, rest = np.zeros((n, 1, 0), np.int64), part[:, None, :]
        for own in books:
            # |rest - c|^2, with |rest|^2 as it differs within a beam
            total = (rest * rest).sum(2)[:, :, None] + (own * own).sum(1) - 2 * (rest.reshape(-1, d) @ own.T).reshape(n, -1, k)
            total = total.reshape(n, -1)
            width = min(beam, total.shape[1])
            pick = np.argpartition(total, width - 1, 1)[:, :width]
            parent, word = pick // k, pick % k
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], 2)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - own[word]
        out[lo : lo + n] = codes[np.arange(n), (rest * rest).sum(2).argmin(1)]
    return out


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> np.ndarray:
    """Codebooks [M, K, d]: k-means of residuals one book after the other, then rounds of beam codes and joint least squares."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    out, rest = np.zeros((books, words, x.shape[1])), x.copy()
    for m in range(books):
        out[m] = _kmeans(rest, words, rng)
        rest = rest - out[m][np.argmin((out[m] ** 2).sum(1) - 2 * rest @ out[m].T, 1)]
    for _ in range(ROUNDS):
        codes = encode(x, out)
        total = books * words
        gram, right = np.eye(total) * 0.1, 0.1 * out.reshape(total, -1)
        for i in range(books):
            for j in range(books):
                pairs = np.bincount(codes[:, i] * words + codes[:, j], minlength=words * words).reshape(words, words)
                gram[i * words : (i + 1) * words, j * words : (j + 1) * words] += pairs
            for w in range(words):
                right[i * words + w] += x[codes[:, i] == w].sum(0)
        out = np.linalg.solve(gram, right).reshape(out.shape)
    return out


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``(vec_id, vector)`` of the rows that take part, and their dimension: that of most rows (smaller, if tied)."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists("vector", lambda v: v != 0))
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = most[0]["d"] if most else 0
    return rows.filter(F.size("vector") == d), d


def remainder(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last term of each vector: bytes [n, d] in units of 1/127 of its largest component, and that [n]."""
    norms = np.abs(left).max(1)
    return np.rint(left * (127 / np.where(norms, norms, 1))[:, None]).astype(np.int8), norms


def decode(codes: np.ndarray, norms: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors, at unit length, that codes (M bytes, then d of the remainder) and the remainders' norms stand for."""
    out = codes[:, len(books) :].view(np.int8) * (norms / 127)[:, None]
    for own, words in zip(books, codes.T, strict=False):
        out += own[words]
    return out / np.maximum(np.sqrt((out * out).sum(1)), 1e-12)[:, None]


def _encode_blocks(books: np.ndarray):
    """``(rep, vector)`` rows -> blocks of codes; rows are dealt to parts by id, so every part has its share of any batch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, CODE_BLOCK):
                cut = batch.slice(lo, CODE_BLOCK)
                x = _matrix(cut.column(1))
                x /= np.sqrt((x * x).sum(1))[:, None]
                codes = encode(x, books)
                left = x
                for own, words in zip(books, codes.T, strict=True):
                    left = left - own[words]
                rest, norms = remainder(left)
                codes = np.concatenate([codes.astype(np.uint8), rest.view(np.uint8)], 1)
                ids = cut.column(0).to_numpy()
                part = (splitmix(ids.view(np.uint64)) % np.uint64(PARTS)).astype(np.int64)
                for p in np.unique(part):
                    own = part == p
                    parts = [pa.array([p], pa.int32()), pa.array([int(ids[own].min())]), *(pa.array([x[own].tobytes()], pa.binary()) for x in (ids, codes, norms))]
                    yield pa.RecordBatch.from_arrays(parts, ["part", "at", "ids", "codes", "norms"])

    return run


def _score_blocks(books: np.ndarray, shortlist: int):
    """Query blocks, each followed by a part's codes block by block -> the best ``shortlist`` codes of each query, once a part."""

    def run(batches):
        import pyarrow as pa

        q_ids, vectors, best = None, None, []

        def add(ids, built):
            for i, lo in enumerate(range(0, len(q_ids), QUERY_SLICE)):
                scores = vectors[lo : lo + QUERY_SLICE] @ built.T
                near, reps = best[i] if i < len(best) else (np.zeros((len(scores), 0)), np.zeros((len(scores), 0), np.int64))
                near, reps = np.concatenate([near, scores], 1), np.concatenate([reps, np.broadcast_to(ids, scores.shape)], 1)
                if near.shape[1] > shortlist:
                    top = np.argpartition(-near, shortlist - 1, 1)[:, :shortlist]
                    near, reps = np.take_along_axis(near, top, 1), np.take_along_axis(reps, top, 1)
                best[i : i + 1] = [(near, reps)]

        def done():
            for i, (near, reps) in enumerate(best):
                own = q_ids[i * QUERY_SLICE : (i + 1) * QUERY_SLICE]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, near.shape[1])), pa.array(reps.reshape(-1)), pa.array(near.reshape(-1))], ["query_id", "rep", "near"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("at", "ids", "vectors", "codes", "norms")}
                if row["at"] is None:
                    yield from done()
                    q_ids, best = np.frombuffer(row["ids"], np.int64), []
                    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(q_ids), -1)
                else:
                    ids = np.frombuffer(row["ids"], np.int64)
                    add(ids, decode(np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["norms"], np.float64), books))
        yield from done()

    return run


def search(table: DataFrame, is_query, k: int = 5, shortlist: int = SHORTLIST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every query row, by cosine in double precision.

    ``is_query``: a condition on ``vec_id``. Vectors that are null, zero, hold null or non-finite
    components, or differ in length from most take no part. Equal vectors are one candidate with its k + 1
    smallest ids, so thousands of copies neither crowd a shortlist nor meet in one task; a repeated id with
    the same vector counts once. Ties go to the smaller id. Fewer candidates than k: all of them.

    Codes (M bytes, d of the remainder and its norm for each vector) are computed once. Each block of queries meets them in ``PARTS``
    streams that hold one block of codes at a time; one shortlist a query leaves a stream, so the shortlists
    of a query are of the same size however many vectors there are. Further columns are ignored.
    """
    spark = table.sparkSession
    rows, d = valid_vectors(table, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], schema)
    number = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("number", number).filter(F.col("number") <= k + 1)
    classes = few.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("members"))
    classes = materialise(classes.select("rep", "vector", "members"), "classes")
    n = classes.count()
    picked = classes.select("rep", "vector").filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < min(1.0, 0.9 * SAMPLE / n) * (1 << 30)).limit(SAMPLE).toPandas()
    sample = np.array(picked.sort_values("rep").vector.tolist(), np.float64).reshape(-1, d)
    if not len(sample):  # so few that the hash drew none
        sample = np.array([r.vector for r in classes.limit(SAMPLE).collect()], np.float64)
    books = fit_books(sample / np.sqrt((sample * sample).sum(1))[:, None])

    queries = materialise(rows.filter(is_query).dropDuplicates(["vec_id", "vector"]), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def query_blocks(batches):
        import pyarrow as pa

        ids, vectors, q = [], [], 0
        for batch in batches:
            q = batch.column(0)[0].as_py() if batch.num_rows else q
            ids.append(batch.column(1).to_numpy())
            vectors.append(_matrix(batch.column(2)))
        if sum(map(len, ids)):
            all_ids, all_vectors = np.concatenate(ids), np.concatenate(vectors)
            all_vectors = all_vectors / np.sqrt((all_vectors * all_vectors).sum(1))[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([all_ids.tobytes()], pa.binary()), pa.array([all_vectors.tobytes()], pa.binary())], ["q", "ids", "vectors"])

    q_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    by_block = queries.select(q_block.alias("q"), "vec_id", "vector").repartitionById(blocks, F.col("q")).mapInArrow(query_blocks, "q int, ids binary, vectors binary")
    codes = materialise(classes.select("rep", "vector").mapInArrow(_encode_blocks(books), "part int, at long, ids binary, codes binary, norms binary"), "codes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = by_block.withColumn("part", every(PARTS))
    offered = codes.withColumn("q", every(blocks))
    met = asked.unionByName(offered, allowMissingColumns=True).repartition("q", "part").sortWithinPartitions("q", "part", F.asc_nulls_first("at"))
    short = met.select("at", "ids", "vectors", "codes", "norms").mapInArrow(_score_blocks(books, shortlist), "query_id long, rep long, near double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "rep"))
    short = short.withColumn("place", best).filter(F.col("place") <= shortlist).select("query_id", "rep")

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("q", "vector") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("vector", "vector")))
    pairs = short.join(classes, "rep").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    scored = pairs.select("query_id", cosine.alias("score"), F.explode("members").alias("vec_id")).filter("vec_id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
