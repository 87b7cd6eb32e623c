"""Exact top-k by inner product: score everything, find each kth value by histograms, then filter.

Scores never leave the tasks that compute them. A pass scores every candidate against every query and
counts the scores in histogram bins; the summed histogram of a query names the bin of its kth value, which
the next pass divides again. A task sends the topmost bins only, down to its own kth score: the kth of all
scores can't be lower. When bins are single values, a last pass returns the scores above the kth value and,
of those equal to it, the smallest ids that are still needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise

#: Components are floor(SCALE * x).
SCALE = 1024
#: Bits of a score that one pass settles.
BITS = 11
#: Queries in a block, and at once; candidates in a block.
QUERY_BLOCK, QUERY_SLICE, CANDIDATE_BLOCK = 4096, 512, 4096
#: Tasks that the candidates of a query block are dealt to, so that a query has so many partial histograms at any size.
PARTS = 16
#: Squared norms beyond this could give scores beyond a long.
MOST_NORM = float(2**60)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part, as integers; rows equal in both count once."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + (v * SCALE) * (v * SCALE))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~F.coalesce(odd, F.lit(True))).filter(norm < MOST_NORM)
    return rows.select("vec_id", F.transform("vector", lambda v: F.floor(v * SCALE)).alias("vector")).distinct()


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _pack(block: int, dtype: str):
    """``(part, vec_id, vector)`` rows of one part -> blocks of ids and vectors as bytes, at most ``block`` each (0: one block)."""

    def run(batches):
        import pyarrow as pa

        def row(part, ids, vectors):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).astype(dtype).tobytes()], pa.binary())], ["part", "ids", "vectors"])

        part, ids, vectors, held = None, [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block or batch.num_rows):
                cut = batch.slice(lo, block or batch.num_rows)
                if block and held and held + cut.num_rows > block:
                    yield row(part, ids, vectors)
                    ids, vectors, held = [], [], 0
                part = cut.column(0)[0].as_py()
                ids.append(cut.column(1).to_numpy().astype(np.int64))
                vectors.append(_matrix(cut.column(2)))
                held += cut.num_rows
        if held:
            yield row(part, ids, vectors)

    return run


def _score(q_ids, q_vectors, c_ids, c_vectors, offset: int):
    """Scores raised by ``offset`` so that none is negative, and -1 for a query's own row."""
    scores = (q_vectors @ c_vectors.T).astype(np.int64)  # doubles hold these sums exactly, else these are longs
    scores += offset
    scores[q_ids[:, None] == c_ids[None, :]] = -1
    return scores


def _top_bins(counts: np.ndarray, need: np.ndarray):
    """Places of the bins of each row from the top until ``need`` is reached."""
    above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
    return np.nonzero((counts > 0) & (above < need[:, None]))


def _scan(dtype: str, exact: bool, offset: int, shift: int, before: int, last: bool):
    """Query blocks, each followed by its candidates: to histogram bins, or at last to ``(query, vec_id, score)`` rows.

    A query's state is the bin that holds its kth score at ``before`` bits, -1 for all, and how many of that bin it needs.
    """
    width = 1 << (before - shift)

    def run(batches):
        import pyarrow as pa

        now = None

        def read(row):
            state = row["state"]
            pos = np.array([s["pos"] for s in state], np.int64)
            ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], dtype)
            vectors = vectors.reshape(len(ids), -1).astype(np.int64 if exact else np.float64)
            bins, need = np.array([s["bin"] for s in state], np.int64), np.array([s["need"] for s in state], np.int64)
            return {"g": row["g"], "pos": pos, "ids": ids[pos], "vectors": vectors[pos], "bin": bins, "need": need, "counts": None if last else np.zeros((len(pos), width), np.int64), "found": []}

        def add(row):
            c_ids = np.frombuffer(row["ids"], np.int64)
            c_vectors = np.frombuffer(row["vectors"], dtype).reshape(len(c_ids), -1).astype(np.int64 if exact else np.float64)
            for lo in range(0, len(now["pos"]), QUERY_SLICE):
                own = slice(lo, lo + QUERY_SLICE)
                scores = _score(now["ids"][own], now["vectors"][own], c_ids, c_vectors, offset)
                if last:
                    at, col = np.nonzero(scores >= np.maximum(now["bin"][own], 0)[:, None])
                    now["found"].append((at + lo, c_ids[col], scores[at, col]))
                    now["found"] = [_needed(now)]
                    continue
                within = (scores >> shift) - (now["bin"][own] * width)[:, None]
                flat = (within + np.arange(len(within))[:, None] * width)[(scores >= 0) & (within >= 0) & (within < width)]
                now["counts"][own] += np.bincount(flat, minlength=len(within) * width).reshape(-1, width)

        def _needed(held):
            """All above the kth score, and the smallest ids of those equal to it."""
            at, ids, scores = (np.concatenate(x) for x in zip(*held["found"]))
            order = np.lexsort((ids, -scores, at))
            at, ids, scores = at[order], ids[order], scores[order]
            tied = scores == held["bin"][at]
            starts = np.r_[True, (at[1:] != at[:-1]) | (scores[1:] != scores[:-1])] if len(at) else np.zeros(0, bool)
            first = np.flatnonzero(starts)
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            keep = ~tied | (place < held["need"][at])
            return at[keep], ids[keep], scores[keep]

        def done():
            n = lambda values, kind: pa.array(values, kind)
            if last:
                at, ids, scores = now["found"][0] if now["found"] else (np.zeros(0, np.int64),) * 3
                return pa.RecordBatch.from_arrays([n(np.full(len(at), now["g"]), pa.int32()), n(now["pos"][at], pa.int32()), n(now["ids"][at], pa.int64()), n(ids, pa.int64()), n(scores - offset, pa.int64())], ["g", "pos", "query_id", "vec_id", "score"])
            at, col = _top_bins(now["counts"], now["need"])
            return pa.RecordBatch.from_arrays([n(np.full(len(at), now["g"]), pa.int32()), n(now["pos"][at], pa.int32()), n(now["bin"][at] * width + col, pa.int64()), n(now["counts"][at, col], pa.int64())], ["g", "pos", "bin", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("g", "state", "ids", "vectors")}
                if row["state"] is None:
                    add(row)
                    continue
                if now:
                    yield done()
                now = read(row)
        if now:
            yield done()

    return run


def search(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k candidates of largest integer inner product of every query row.

    ``is_query``: a condition on ``vec_id``; candidates are all rows but those of the query's own id. Ties go
    to the smaller id; fewer candidates than k: all of them. Vectors that are null or hold null or non-finite
    components take no part, nor do null ids, empty vectors, vectors of another length than most (the shorter, if tied), and
    vectors so large (a squared norm of 2^60) that their scores may be no longs. Rows equal in id and vector
    count once; an id that repeats with other vectors is a candidate, and a query, for each. Equal vectors,
    however many, are spread over all parts by their ids. Further columns are ignored; an empty table gives an
    empty result.

    Candidates meet the queries of a block in ``PARTS`` streams, each of which holds a block of either at a
    time and a histogram of the queries; so rows sent for a query are at most k x PARTS a pass at any size.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = materialise(integer_vectors(table, id_col, vector_col), "vectors")
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not most:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == most[0]["d"])
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(norm).alias("norm"), F.max(F.array_max(F.transform("vector", F.abs))).alias("top")).first()
    n, groups = facts["n"], max(1, -(-facts["q"] // QUERY_BLOCK))
    if not facts["q"]:
        return spark.createDataFrame([], schema)
    exact = facts["norm"] * 1.01 >= 2**53  # beyond it doubles don't hold every sum
    dtype = "<i4" if (facts["top"] or 0) < 2**31 else "<i8"
    offset = 1 << int(facts["norm"] * 1.01 + 1).bit_length()
    parts = min(PARTS, -(-n // 1024))

    def packed(of: DataFrame, pieces: int, block: int, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(pieces)).cast("int")
        dealt = of.select(part.alias("part"), "vec_id", "vector").repartitionById(pieces, F.col("part"))
        return materialise(dealt.mapInArrow(_pack(block, dtype), "part int, ids binary, vectors binary"), name)

    queries = packed(rows.filter(is_query), groups, 0, "queries").withColumnRenamed("part", "g")
    candidates = packed(rows, parts, CANDIDATE_BLOCK, "candidates")
    start = F.transform(F.sequence(F.lit(0), (F.length("ids") / 8 - 1).cast("int")), lambda i: F.struct(i.alias("pos"), F.lit(0).cast("long").alias("bin"), F.lit(k).cast("long").alias("need")))
    state = queries.select("g", start.alias("state"))

    def scan(shift: int, before: int, last: bool, out: str) -> DataFrame:
        asked = queries.join(state, "g").select("g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "state", "ids", "vectors")
        offered = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "part", F.lit(None).cast(asked.schema["state"].dataType).alias("state"), "ids", "vectors")
        met = asked.unionByName(offered).repartition("g", "part").sortWithinPartitions("g", "part", F.col("state").isNull())
        return met.drop("part").mapInArrow(_scan(dtype, exact, offset, shift, before, last), out)

    before = offset.bit_length()  # raised scores lie below 2 x offset
    while before:
        shift = max(0, before - BITS)
        bins = scan(shift, before, False, "g int, pos int, bin long, n long").groupBy("g", "pos", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("g", "pos").orderBy(F.desc("bin"))
        bins = bins.withColumn("reached", F.sum("n").over(down))
        held = state.select("g", F.explode("state").alias("s")).select("g", "s.pos", "s.need").join(bins, ["g", "pos"], "left")
        first = F.max(F.when(F.col("reached") >= F.col("need"), F.struct("bin", (F.col("need") - F.col("reached") + F.col("n")).alias("need"))))
        kth = held.groupBy("g", "pos").agg(first.alias("kth"))
        # a query of fewer candidates than k takes all: its bin is -1, and no later bin is
        own = F.struct("pos", F.coalesce("kth.bin", F.lit(-1)).cast("long").alias("bin"), F.coalesce("kth.need", F.lit(k)).cast("long").alias("need"))
        state = materialise(kth.select("g", own.alias("s")).groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("state")), "state")
        before = shift
    found = scan(0, 0, True, "g int, pos int, query_id long, vec_id long, score long")
    order = F.row_number().over(Window.partitionBy("g", "pos").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
