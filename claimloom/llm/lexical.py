"""Ranked lexical search by block maxima: an index of compressed posting blocks, and Block-Max WAND over it.

The index is partitioned by documents. A shard holds the documents of some megabytes of text, numbered by
ascending id; a term's postings (document number and impact) stand in blocks of 128, each block compressed
by itself and described by its last document and its greatest impact. A search joins the index with the
queries' terms only, and evaluates a block of queries on one shard at a time; of each query the k best of a
shard leave it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, text_bytes

#: Bytes of text and documents of a shard, about; a longer document is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Postings in a block; spans of documents that are opened at once; queries evaluated together.
BLOCK, STRIDE, QUERY_BLOCK = 128, 16, 256
#: Rows of query terms up to which they are broadcast; more are joined by a shuffle that splits common terms.
BROADCAST_ROWS, SALTS = 200_000, 16

#: Terms: maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a score that a term's weight is multiplied with, in millionths."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as variable-length bytes, seven bits each, low bits first; and where each begins."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        size += values >= np.uint64(1 << bits)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        own = size > i
        more = (size[own] > i + 1).astype(np.uint8) << 7
        out[at[own] + i] = ((values[own] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | more
    return out, at


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.zeros(0, np.int64)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = [len(terms_of(t)) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([sum(s > 0 for s in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["n", "l"])

    row = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


INDEX = "shard long, term binary, n int, block_last binary, block_max binary, block_at binary, postings binary, ids array<long>"


def _shard_rows(shard: int, held: list, n_docs: int, n_terms: int):
    """One shard's index: a row a term, and a row without a term that has the documents' ids."""
    import pyarrow as pa

    held.sort(key=lambda d: (d[0] is None, d[0] or 0))
    lengths = np.array([len(d[1]) for d in held], np.int64)
    vocabulary = sorted(set().union(*(d[2] for d in held)))
    number = {t: i for i, t in enumerate(vocabulary)}
    local = [np.fromiter((number[t] for t in d[2]), np.int64, len(d[2])) for d in held]
    terms = np.concatenate([own[d[1]] for own, d in zip(local, held)])
    key, tf = np.unique(terms * len(held) + np.repeat(np.arange(len(held)), lengths), return_counts=True)
    term, doc = key // len(held), key % len(held)
    m = 25 + 75 * lengths * n_docs // n_terms
    impact = impacts(tf.astype(np.int64), m[doc])

    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    counts = np.diff(np.r_[starts, len(term)])
    place = np.arange(len(term)) - np.repeat(starts, counts)
    first = np.flatnonzero(place % BLOCK == 0)
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]  # blocks are read without the ones before them
    data, at = pack_numbers(np.stack([gap, impact], 1).reshape(-1))
    block_end = np.r_[first[1:], len(term)]
    block_last, block_max, block_at = doc[block_end - 1], np.maximum.reduceat(impact, first), at[2 * first]
    blocks = -(-counts // BLOCK)
    block_from = np.r_[0, np.cumsum(blocks)]
    posting_from = np.r_[block_at[block_from[:-1]], len(data)]
    block_at = block_at - np.repeat(posting_from[:-1], blocks)

    def cut(values, ends, kind):
        data = values.astype(kind)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])

    n, none = len(vocabulary), pa.nulls(len(vocabulary), pa.list_(pa.int64()))
    names = ["shard", "term", "n", "block_last", "block_max", "block_at", "postings", "ids"]
    yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(vocabulary, pa.binary()), pa.array(counts, pa.int32()), cut(block_last, block_from, np.int32), cut(block_max, block_from, np.int32), cut(block_at, block_from, np.int32), cut(data, posting_from, np.uint8), none], names)
    absent = pa.nulls(1, pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), absent, pa.array([len(held)], pa.int32()), absent, absent, absent, absent, pa.array([[d[0] for d in held]], pa.list_(pa.int64()))], names)


def build_index(docs: DataFrame, n_docs: int, n_terms: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all terms of all documents; no shuffle. Documents without a term aren't in it."""

    def run(batches):
        from pyspark import TaskContext

        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, text_bytes(batch.column(1))):
                seen: dict[bytes, int] = {}
                order = np.fromiter((seen.setdefault(t, len(seen)) for t in terms_of(text)), np.int32)
                if not len(order):
                    continue
                if held and (size + len(text) > shard_bytes or len(held) >= SHARD_DOCS):
                    yield from _shard_rows(shard, held, n_docs, n_terms)
                    shard, held, size = shard + 1, [], 0
                held.append((doc_id, order, list(seen)))
                size += len(text)
        if held:
            yield from _shard_rows(shard, held, n_docs, n_terms)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


class Postings:
    """A term's postings in one shard; blocks are unpacked when first asked for."""

    def __init__(self, block_last: bytes, block_max: bytes, block_at: bytes, postings: bytes):
        self.last, self.max = np.frombuffer(block_last, np.int32), np.frombuffer(block_max, np.int32).astype(np.int64)
        self.at = np.r_[np.frombuffer(block_at, np.int32), len(postings)]
        self.data = np.frombuffer(postings, np.uint8)
        self.blocks: dict[int, tuple] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.blocks:
            pairs = unpack_numbers(self.data[self.at[i] : self.at[i + 1]])
            self.blocks[i] = (np.cumsum(pairs[0::2]), pairs[1::2])
        return self.blocks[i]


def best_of_shard(lists: list[tuple[Postings, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best documents above 0, best first, ties to the smaller number.

    The last documents of all blocks cut the shard into spans. In each span every list stands in one block
    (the shallow move), so the weighted maxima bound what a document of the span can score. Pivots are the
    spans whose bound reaches the kth best score so far: the span of the largest bound first, to have such
    a score, then in document order some at a time. Only blocks that lie on a pivot are unpacked.
    """
    lists = [(own, weight) for own, weight in lists if weight > 0 and len(own.last)]
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not lists:
        return docs, scores
    edges = np.unique(np.concatenate([own.last for own, _ in lists])).astype(np.int64)
    stands, bound = [], np.zeros(len(edges), np.int64)
    for own, weight in lists:
        block = np.searchsorted(own.last, edges)
        on = block < len(own.last)
        bound[on] += weight * own.max[block[on]]
        stands.append(np.where(on, block, -1))
    opened, least, at = np.zeros(len(edges), bool), 0, 0
    while True:
        if at == 0 and not opened.any():
            pivots = np.array([int(bound.argmax())])
        else:
            pivots = at + np.flatnonzero((bound[at:] >= max(least, 1)) & ~opened[at:])[:STRIDE]
            if not len(pivots):
                return docs, scores
            at = int(pivots[-1]) + 1
        opened[pivots] = True
        low = int(edges[pivots[0] - 1]) + 1 if pivots[0] else 0
        total = np.zeros(int(edges[pivots[-1]]) - low + 1, np.int64)
        for (own, weight), stand in zip(lists, stands):
            for i in np.unique(stand[pivots]):
                if i >= 0:
                    found, impact = own.block(int(i))
                    inside = slice(*np.searchsorted(found, (low, low + len(total))))
                    total[found[inside] - low] += weight * impact[inside]
        hit = np.flatnonzero(total >= max(least, 1))
        hit = hit[np.isin(np.searchsorted(edges, hit + low), pivots)]  # other spans are not whole
        docs, scores = np.r_[docs, hit + low], np.r_[scores, total[hit]]
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        least = int(scores[-1]) if len(scores) == k else 0


def _evaluate(k: int):
    """One shard's postings of a block of queries -> the k best of each query."""

    def run(table):
        import pyarrow as pa

        ids, lists = None, {}
        for row in table.to_pylist():
            if row["term"] is None:
                ids = row["ids"]
                continue
            own = Postings(row["block_last"], row["block_max"], row["block_at"], row["postings"])
            for ask in row["asks"]:
                lists.setdefault((ask["query"], ask["item_id"]), []).append((own, ask["weight"]))
        out = [(query, item, ids[d], int(s)) for (query, item), own in lists.items() for d, s in zip(*best_of_shard(own, k))]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents above 0 of every item, equal scores by ascending id.

    Null and empty texts, and texts without a term, have no document and no query; very long texts are
    indexed whole, in a shard of their own; rows of documents that repeat an id are ranked each, a null id
    after all others of its score; items equal in id and text are one, items of one id and other texts are
    ranked each, null ids too; further columns are ignored; empty tables give an empty result.

    Query terms are broadcast only if they are at most ``broadcast_rows``; else both sides are dealt by term
    and shard number, so that a term of all shards is no hot key.
    """
    spark = docs.sparkSession
    n_docs, n_terms = corpus_size(docs)
    if not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    index = materialise(build_index(docs, n_docs, n_terms, shard_bytes), "index")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(i, q, t, n) for i, q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))) for t, n in Counter(terms_of(text)).items()]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["item_id", "query", "term", "times"])

    asked = materialise(items.select("item_id", F.xxhash64("item_id", "text").alias("query"), "text").mapInArrow(split, "item_id long, query long, term binary, times long"), "terms")
    small = asked.count() <= broadcast_rows

    def joined(lists: DataFrame, terms: DataFrame) -> DataFrame:
        if small:
            return lists.join(F.broadcast(terms), "term")
        salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return lists.withColumn("salt", F.pmod("shard", F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")

    listed = index.filter("term IS NOT NULL")
    df = joined(listed.select("shard", "term", "n"), asked.select("term").distinct()).groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    blocks = max(1, -(-asked.select("query").distinct().count() // QUERY_BLOCK))
    block = F.pmod("query", F.lit(blocks)).cast("int")
    asks = asked.join(df, "term").groupBy("term", block.alias("block")).agg(F.collect_list(F.struct("query", "item_id", (weight * F.col("times")).cast("long").alias("weight"))).alias("asks"))
    asks = materialise(asks, "asks")
    met = joined(listed.drop("ids"), asks)
    ids = index.filter("term IS NULL").select("shard", "ids", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    best = met.unionByName(ids, allowMissingColumns=True).groupBy("shard", "block").applyInArrow(_evaluate(k), "query long, item_id long, doc_id long, score long")
    order = F.row_number().over(Window.partitionBy("query", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", order).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
