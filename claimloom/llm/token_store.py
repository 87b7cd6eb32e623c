"""Content-addressed store of token ids.

Every document's id stream (its text's ids, then an end id) is cut where a rolling hash of the last 16
ids says so; a chunk is addressed by its BLAKE2b-128 digest and stored once. A recipe lists a document's
chunks; recipes lie in ascending id order in shards, each with a manifest whose Merkle root covers them.

Layout under the store's path (Parquet, zstd):
  parts/kind=chunk    digest, n, payload (n ids, little-endian unsigned 16 bits)
  parts/kind=recipe   as encoded, unordered; the source of ``recipes``
  recipes             shard, local_start, doc_id, n, digests (16 bytes each), lens (uint32 each), root
  manifests           shard, n_docs, n_ids, start (ids of all shards before it), root
"""

from __future__ import annotations

import contextlib
import hashlib
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import encoding
from claimloom.llm.common import local_file, slices_by_bytes, text_bytes
from claimloom.llm.encoding import encoder

WINDOW = 16
MIN_IDS, MEAN_BITS, MAX_IDS = 128, 10, 8192
#: Recipes in a shard, at most.
SHARD = 65_536
#: Bytes of an Arrow batch that a writing task holds, and payloads that a reading task opens at once.
BATCH_BYTES, OPENED = 1 << 22, 1_024
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def cut_candidates(ids: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of the last ``WINDOW`` ids has ``MEAN_BITS`` zero bits, ascending.

    Streams may lie in a row: what a place within ``WINDOW`` of a stream's start depends on never cuts, as
    chunks have ``MIN_IDS`` ids.
    """
    h = _GEAR[ids]
    for width in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 ids, the older ones shifted
        older = h[:-width] << np.uint32(2 * width)
        h = h.copy()
        h[width:] += older
    return np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1


def cut_points(n: int, candidates: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids: the first candidate after ``MIN_IDS`` ends one, ``MAX_IDS`` at the latest."""
    if n <= MIN_IDS:
        return [n] if n else []
    ends, at = [], 0
    for c in candidates:
        while c - at > MAX_IDS:
            at += MAX_IDS
            ends.append(at)
        if c - at >= MIN_IDS and c < n:
            ends.append(c)
            at = c
    while n - at > MAX_IDS:
        at += MAX_IDS
        ends.append(at)
    return [*ends, n]


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is; no leaves: the address of nothing."""
    if not leaves:
        return address(b"")
    level = [address(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [address(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _shift_tables() -> np.ndarray:
    """[bit][byte position][byte value]: CRC-32 register after 2**bit zero bytes, for each byte of the register."""
    step = np.zeros(32, np.uint64)  # one zero byte, as images of single bits
    for bit in range(32):
        reg = 1 << bit
        for _ in range(8):
            reg = (reg >> 1) ^ (0xEDB88320 if reg & 1 else 0)
        step[bit] = reg

    def apply(matrix: np.ndarray, value: int) -> int:
        out = 0
        for bit in range(32):
            if value >> bit & 1:
                out ^= int(matrix[bit])
        return out

    tables = np.zeros((40, 4, 256), np.uint32)
    for k in range(40):
        for pos in range(4):
            for v in range(256):
                tables[k, pos, v] = apply(step, v << (8 * pos)) if v & (v - 1) == 0 else tables[k, pos, v & (v - 1)] ^ tables[k, pos, v & -v]
        step = np.array([apply(step, int(x)) for x in step], np.uint64)
    return tables


_tables: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 contributes to that of a longer string in which ``n_bytes`` bytes follow.

    crc32(a + b) is crc_shift(crc32(a), len(b)) xor crc32(b), so a document's CRC is the xor over its chunks.
    """
    if not _tables:
        _tables.append(_shift_tables())
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for bit in range(40):
        on = (n >> bit) & 1 == 1
        if on.any():
            x, t = out[on], _tables[0][bit]
            out[on] = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
    return out


_PARTS = "kind string, key binary, n long, payload binary, doc_id long, digests binary, lens binary, root binary"


def _encode_parts(tokenizer: str, end_id: int):
    def run(batches):
        import pyarrow as pa

        enc = encoder(local_file(tokenizer))
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for lo, hi in slices_by_bytes([len(t) for t in texts], 1 << 21):
                ids, stops = enc.encode_row([t.decode() for t in texts[lo:hi]], end_id)
                found, payloads = cut_candidates(ids), memoryview(ids.astype("<u2", copy=False)).cast("B")
                near = np.searchsorted(found, [0, *stops.tolist()], "right").tolist()
                chunks: dict[bytes, tuple] = {}  # of this slice; across slices they meet by digest
                recipes, first = [], 0
                for k, stop in enumerate(stops.tolist()):
                    ends = cut_points(stop - first, (found[near[k] : near[k + 1]] - first).tolist() if stop - first > MIN_IDS else [])
                    digests, at = [], 0
                    for end in ends:
                        payload = payloads[2 * (first + at) : 2 * (first + end)]
                        digests.append(address(payload))
                        chunks.setdefault(digests[-1], (end - at, payload))
                        at = end
                    recipes.append((stop - first, b"".join(digests), np.diff([0, *ends]).astype("<u4").tobytes() if len(ends) > 1 else (stop - first).to_bytes(4, "little"), merkle_root(digests)))
                    first = stop
                n, digests, lens, roots = zip(*recipes, strict=True)
                none, empty = [None] * len(chunks), [None] * len(recipes)
                cols = [["chunk"] * len(chunks) + ["recipe"] * len(recipes), [*chunks, *empty], [*(x[0] for x in chunks.values()), *n], [*(x[1] for x in chunks.values()), *empty], none + doc_ids[lo:hi], [*none, *digests], [*none, *lens], [*none, *roots]]
                types = [pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["kind", "key", "n", "payload", "doc_id", "digests", "lens", "root"])
            pa.default_memory_pool().release_unused()  # what Arrow keeps of a batch's splits would stay beside the JVM's memory

    return run


def _once(batches):
    """Keeps the first of equal chunks, which follow each other."""
    import pyarrow as pa
    import pyarrow.compute as pc

    encoding.release()
    last = None
    for batch in batches:
        keys = batch.column(1)
        before = pa.concat_arrays([pa.array([last], pa.binary()), keys.slice(0, max(len(keys) - 1, 0))]) if len(keys) else keys
        yield batch.filter(pc.fill_null(pc.not_equal(keys, before), True))
        last = keys[len(keys) - 1].as_py() if len(keys) else last


class MerkleStack:
    """The root of ``merkle_root`` over leaves that come one by one; holds one node for each level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node = address(b"\0" + leaf)
        for k, held in enumerate(self.levels):
            if held is None:
                self.levels[k] = node
                return
            node, self.levels[k] = address(b"\1" + held + node), None
        self.levels.append(node)

    def root(self) -> bytes:
        node = None
        for held in self.levels:  # the lowest level is the rightmost part; what has no neighbour moves up as it is
            if held is not None:
                node = held if node is None else address(b"\1" + held + node)
        return address(b"") if node is None else node


def recipe_leaf(doc_id: int | None, n: int, root: bytes) -> bytes:
    return f"{doc_id},{n},".encode() + root


def _place(batches):
    """Adds each recipe's shard, ``SHARD`` recipes at most and in the order of the partition, and its start within it."""
    import pyarrow as pa

    encoding.release()
    shard, filled, at = int(TaskContext.get().partitionId()) << 32, 0, 0
    for batch in batches:
        n, lo = batch.column("n").to_numpy(), 0
        while lo < len(n):
            part = batch.slice(lo, SHARD - filled)
            ends = at + np.cumsum(n[lo : lo + part.num_rows])
            starts = ends - n[lo : lo + part.num_rows]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(starts, pa.int64()), pa.array(np.full(part.num_rows, shard), pa.int64())], [*batch.schema.names, "local_start", "shard"])
            lo, filled, at = lo + part.num_rows, filled + part.num_rows, int(ends[-1])
            if filled == SHARD:
                shard, filled, at = shard + 1, 0, 0


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of ``BATCH_BYTES`` for what is written within: each is held in the JVM and in Python, beside the piece cache."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_store(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the store.

    Null text is empty (just the end id); an empty table gives a store without rows. Ids may be null
    (they come first) or repeated: such documents follow each other, ordered by content. Only chunks
    and recipes are shuffled once, by digest; ordering moves recipes alone.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = chosen.mapInArrow(_encode_parts(tokenizer, end_id), _PARTS)
    # equal chunks of a slice are one already; a chunk that every slice has is a row for each slice
    dealt = parts.repartition(F.coalesce("key", F.xxhash64("doc_id", "root").cast("string").cast("binary"))).sortWithinPartitions("key")
    with _small_batches(spark):
        dealt.mapInArrow(_once, _PARTS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    recipes = spark.read.schema(_PARTS).parquet(f"{path}/parts").filter("kind = 'recipe'").select("doc_id", "n", "digests", "lens", "root")
    placed = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").mapInArrow(_place, "doc_id long, n long, digests binary, lens binary, root binary, local_start long, shard long")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    shards = _shard_summaries(spark.read.parquet(f"{path}/recipes"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/manifests")


def _summarise(batches):
    """Recipes in the order of their shards -> the shards' counts and Merkle roots."""
    import pyarrow as pa

    encoding.release()
    out, now, tree = [], None, MerkleStack()
    for batch in batches:
        for shard, doc_id, n, root in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "root")), strict=True):
            if shard != now:
                if out:
                    out[-1].append(tree.root())
                out.append([shard, 0, 0])
                now, tree = shard, MerkleStack()
            out[-1][1] += 1
            out[-1][2] += n
            tree.add(recipe_leaf(doc_id, n, root))
    if out:
        out[-1].append(tree.root())
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], ["shard", "n_docs", "n_ids", "root"])


def _shard_summaries(recipes: DataFrame) -> DataFrame:
    """(shard, n_docs, n_ids, root): the root covers ids, lengths and roots in order; a shard holds one range of ids."""
    ordered = recipes.select("shard", "local_start", "doc_id", "n", "root").repartition("shard").sortWithinPartitions("shard", "local_start")
    return ordered.mapInArrow(_summarise, "shard long, n_docs long, n_ids long, root binary")


def _check_chunks(batches):
    import pyarrow as pa

    encoding.release()
    for batch in (whole.slice(lo, OPENED) for whole in batches for lo in range(0, whole.num_rows, OPENED)):
        digests, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sound = [address(p) == d for d, p in zip(digests, payloads, strict=True)]
        crcs = [zlib.crc32(np.frombuffer(p, "<u2").astype("<u4").tobytes()) for p in payloads]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // 2 for p in payloads], pa.int64()), pa.array(crcs, pa.int64()), pa.array(sound, pa.bool_())], ["digest", "found", "crc", "sound"])


def _open_recipes(batches):
    """One row for each chunk of a document; ``matches`` tells whether the recipe has the root it names."""
    import pyarrow as pa

    encoding.release()
    for batch in (whole.slice(lo, OPENED) for whole in batches for lo in range(0, whole.num_rows, OPENED)):
        shard, local, doc, n, digests, lens, root = (c.to_pylist() for c in batch.columns)
        rows = []
        for i in range(batch.num_rows):
            own = [digests[i][k : k + 16] for k in range(0, len(digests[i]), 16)]
            sizes = np.frombuffer(lens[i], "<u4").astype(np.int64)
            matches = merkle_root(own) == root[i] and int(sizes.sum()) == n[i] and len(own) == len(sizes)
            after = int(sizes.sum()) - np.cumsum(sizes)
            rows += [(shard[i], local[i], doc[i], n[i], d, int(s), int(a), matches) for d, s, a in zip(own, sizes, after, strict=True)]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["shard", "local_start", "doc_id", "n", "digest", "size", "after", "matches"])


def _contribute(batches):
    import pyarrow as pa

    for batch in batches:
        crc, after = batch.column("crc").to_numpy(), batch.column("after").to_numpy()
        part = crc_shift(crc, 4 * after).astype(np.int64)
        keep = [n for n in batch.schema.names if n not in ("crc", "after")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(part, pa.int64())], [*keep, "part"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, verified)`` of every document, from the files alone.

    Every chunk's payload is read and hashed again; recipes are held against their Merkle roots and shards
    against their manifests. Payloads stay where they are read: a document's CRC is composed from its
    chunks' CRCs, so only digests and lengths are shuffled. ``verified`` is false where a chunk is missing
    or altered, or a recipe or shard doesn't match its root.
    """
    chunks = spark.read.schema(_PARTS).parquet(f"{path}/parts").filter("kind = 'chunk'").select("key", "payload").mapInArrow(_check_chunks, "digest binary, found long, crc long, sound boolean")
    recipes, manifests = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifests")
    shards = manifests.alias("m").join(_shard_summaries(recipes).alias("s"), "shard", "left").select("shard", "start", ((F.col("m.root") == F.col("s.root")) & (F.col("m.n_ids") == F.col("s.n_ids"))).alias("shard_ok"))
    opened = recipes.select("shard", "local_start", "doc_id", "n", "digests", "lens", "root").mapInArrow(_open_recipes, "shard long, local_start long, doc_id long, n long, digest binary, size long, after long, matches boolean")
    joined = opened.join(chunks, "digest", "left").select("shard", "local_start", "doc_id", "n", "after", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce(F.col("sound") & (F.col("found") == F.col("size")) & F.col("matches"), F.lit(False)).alias("sound"))
    parts = joined.mapInArrow(_contribute, "shard long, local_start long, doc_id long, n long, sound boolean, part long")
    whole = parts.groupBy("shard", "local_start", "doc_id", "n").agg(F.bit_xor("part").alias("ids_crc32"), F.min("sound").alias("sound"))
    return whole.join(shards, "shard").select("doc_id", (F.col("start") + F.col("local_start")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32", (F.col("sound") & F.coalesce("shard_ok", F.lit(False))).alias("verified"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids array<int>)``: every document's ids, put together from its chunks in order."""
    chunks = spark.read.schema(_PARTS).parquet(f"{path}/parts").filter("kind = 'chunk'").select(F.col("key").alias("digest"), "payload")
    opened = spark.read.parquet(f"{path}/recipes").select("shard", "local_start", "doc_id", "n", "digests", "lens", "root").mapInArrow(_open_recipes, "shard long, local_start long, doc_id long, n long, digest binary, size long, after long, matches boolean")
    parts = opened.join(chunks, "digest").groupBy("shard", "local_start", "doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("k"), "payload"))).alias("parts"))
    starts = spark.read.parquet(f"{path}/manifests").select("shard", "start")

    @F.pandas_udf("array<int>")
    def ids(rows):
        return rows.map(lambda r: np.frombuffer(b"".join(x["payload"] for x in r), "<u2").astype(np.int32))

    return parts.join(starts, "shard").select("doc_id", (F.col("start") + F.col("local_start")).alias("start"), ids("parts").alias("ids"))
