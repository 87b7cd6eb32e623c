"""SimHash near-dedup: tiled exact comparison with numpy xor and bit counts.

A fingerprint takes a majority vote over the XXH64 of a text's word shingles, bit by bit. Distinct
fingerprints lie in tiles by the population counts of their four 16-bit words; differing bits are at
least the sum of the differences of these counts, so tile pairs beyond the radius are skipped.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from claimloom.llm import encoding
from claimloom.llm.common import materialise, slices_by_bytes, splitmix, text_bytes

#: Distinct fingerprints beyond which every tile is split into one more part.
TILE_ROWS = 5_000_000

#: Texts of a Jaccard of 0.8 differ in fewer bits of the first sketch word, and of both; the README has the measured recall.
NEAR_64, NEAR_128 = 22, 40
#: Smallest shingle hashes of a sketch; sketches, and shingles, of a tile; rows of a strip within it; columns of a product.
BANDS, TILE, TILE_SHINGLES, STRIP, COLUMNS = 8, 512, 1 << 20, 128, 2048
#: Two sets of a Jaccard of 0.8 lie in the same or in neighbouring powers of this size.
SIZE_STEP = 1.2625

#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_slices(buf: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of one buffer, all slices of a length at once."""
    padded = buf + b"\0" * 8
    n = len(buf) + 1
    u64 = np.ndarray((n,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((n,), "<u4", padded, strides=(1,))
    u8 = np.frombuffer(padded, np.uint8)
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for size, lo, hi in zip(lengths.tolist(), first, [*first[1:], len(order)], strict=True):
        idx = order[lo:hi]
        if size > 256:
            import xxhash

            for i in idx.tolist():
                out[i] = xxhash.xxh64_intdigest(buf[starts[i] : starts[i] + size], seed)
            continue
        p, left, s = starts[idx], size, np.uint64(seed)
        with np.errstate(over="ignore"):
            if size >= 32:
                acc = [np.full(len(p), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
                while left >= 32:
                    acc = [_round(a, u64[p + 8 * k]) for k, a in enumerate(acc)]
                    p, left = p + 32, left - 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ _round(np.uint64(0), a)) * P1 + P4
            else:
                h = np.full(len(p), s + P5, np.uint64)
            h += np.uint64(size)
            while left >= 8:
                h = _rotl(h ^ _round(np.uint64(0), u64[p]), 27) * P1 + P4
                p, left = p + 8, left - 8
            if left >= 4:
                h = _rotl(h ^ (u32[p].astype(np.uint64) * P1), 23) * P2 + P3
                p, left = p + 4, left - 4
            while left:
                h = _rotl(h ^ (u8[p].astype(np.uint64) * P5), 11) * P1
                p, left = p + 1, left - 1
            h ^= h >> np.uint64(33)
            h *= P2
            h ^= h >> np.uint64(29)
            h *= P3
            h ^= h >> np.uint64(32)
        out[idx] = h
    return out


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each run of hashes; ``counts``: lengths of the runs, none 0."""
    parts = -(-counts // 255)
    run_start = np.cumsum(counts) - counts
    part_of = np.repeat(np.arange(len(counts)), parts)
    within = np.arange(len(part_of)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = run_start[part_of] + 255 * within
    first = np.cumsum(parts) - parts
    mask, out = np.uint64(0x0101010101010101), np.zeros(len(counts), np.uint64)
    for k in range(8):  # eight counters of a byte each in a word; 255 hashes can't overflow them
        sums = np.add.reduceat((hashes >> np.uint64(k)) & mask, cuts)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = 2 * ones > counts[:, None]
        for byte in range(8):
            out |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which texts have words, XXH64 of their shingles, run by run, lengths of the runs); fewer than ``words``: of the whole sequence."""
    split = [t.lower().split() for t in texts]  # of bytes: A-Z only, and exactly 0x20 and 0x09 to 0x0D
    have = np.array([i for i, w in enumerate(split) if w], np.int64)
    if not len(have):
        return have, np.zeros(0, np.uint64), have
    buf = b"\n".join(b" ".join(split[i]) for i in have)
    u8 = np.frombuffer(buf, np.uint8)
    seps = np.flatnonzero((u8 == 32) | (u8 == 10))
    starts, ends = np.concatenate([[0], seps + 1]), np.concatenate([seps, [len(buf)]])
    n = np.array([len(split[i]) for i in have], np.int64)
    shingles = np.maximum(n - words + 1, 1)
    first = np.repeat(np.cumsum(n) - n, shingles) + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = first + np.repeat(np.minimum(n, words), shingles) - 1
    return have, xxh64_slices(buf, starts[first], ends[last] - starts[first]), shingles


def fingerprint_texts(texts: list[bytes], words: int = 3) -> np.ndarray:
    """Fingerprints of UTF-8 texts; without words: zero; fewer than ``words``: of the whole sequence."""
    have, hashes, counts = _shingle_hashes(texts, words)
    out = np.zeros(len(texts), np.uint64)
    if len(have):
        out[have] = majority(hashes, counts)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``(id, fp)``: the fingerprint of every whole text as a signed long; null text has no words. No shuffle.

    ``keep`` names columns to carry along, in a struct ``row``.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(1))
            got = [fingerprint_texts(texts[lo:hi], words) for lo, hi in slices_by_bytes([len(t) for t in texts], 1 << 21)]
            fp = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("row")] if keep else []))
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("fp", LongType()), *chosen.schema.fields[2:]])
    return chosen.mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> as few that connect the same: each node with the smallest of its component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(home: np.ndarray, other: np.ndarray, radius: int, side: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two sets of fingerprints, as a forest; compared in squares of ``side``."""
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i in range(0, len(home), side):
        for j in range(0, len(other), side):
            a, b = home[i : i + side], other[j : j + side]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            real = a[x] != b[y]
            if real.any():
                u, v = _forest(a[x[real]], b[y[real]])
                found_a.append(u)
                found_b.append(v)
    return _forest(np.concatenate(found_a), np.concatenate(found_b)) if len(found_a) > 1 else (found_a[0], found_b[0])


def _link_tiles(radius: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, homes, visits = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            src, dst = [], []
            for _, group in itertools.groupby(range(len(keys)), lambda i: keys[i]):  # a tile's visitors lie together
                group = list(group)
                home = np.frombuffer(homes[group[0]], np.uint64)
                a, b = _compare(home, np.frombuffer(b"".join(visits[i] for i in group), np.uint64), radius)
                src.append(a)
                dst.append(b)
            both = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (src, dst)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["src", "dst"])

    return run


def tile_links(distinct: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """``(src, dst)``: links that connect what lies within ``radius`` bits, of a frame of ``n`` distinct longs ``fp``.

    Every two tiles whose counts allow a link meet once: a tile visits the half of its neighbours that
    follows it, and itself.
    """
    parts = max(1, -(-n // TILE_ROWS))
    pops = [F.bit_count(F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(0xFFFF)).cast("int") for k in range(4)]
    part = F.pmod(F.xxhash64("fp"), F.lit(parts)).cast("int")
    fps = distinct.select("fp", *(p.alias(f"p{k}") for k, p in enumerate(pops)), part.alias("part"))

    @F.pandas_udf("binary")
    def packed(values):
        return values.map(lambda x: np.asarray(x, np.int64).tobytes())

    tiles = materialise(fps.groupBy("p0", "p1", "p2", "p3", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("p0", "p1", "p2", "p3", "part", packed("fps").alias("fps")), "tiles")
    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    steps = F.array(*(F.array(*map(F.lit, (*d, s))) for d in near for s in range(parts)))
    visits = tiles.select(F.explode(steps).alias("step"), "p0", "p1", "p2", "p3", "part", F.col("fps").alias("visitors"))
    same = (F.col("step")[0] == 0) & (F.col("step")[1] == 0) & (F.col("step")[2] == 0) & (F.col("step")[3] == 0)
    visits = visits.filter(~same | (F.col("step")[4] >= F.col("part")))
    keys = ["p0", "p1", "p2", "p3", "part"]
    visits = visits.select(*((F.col(f"p{k}") + F.col("step")[k]).alias(f"p{k}") for k in range(4)), F.col("step")[4].alias("part"), "visitors")
    met = tiles.hint("merge").join(visits, keys).sortWithinPartitions(*keys)
    key = F.concat_ws(",", *keys).alias("key")
    return met.select(key, "fps", "visitors").mapInArrow(_link_tiles(radius), "src long, dst long").distinct()


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, label)``: the smallest node reachable, for every node that has a link.

    Each round takes the smallest label among neighbours, then the label of that label, which halves
    paths; every round is written to the shared folder. Only the count of changes comes to the driver.
    """
    edges = links.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    edges = materialise(edges.union(edges.select("b", "a")).distinct(), "links")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        offers = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        better = labels.join(offers.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        better = materialise(better, "labels")
        jump = better.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = materialise(better.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = jumped.filter("old <> label").count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``(id, fingerprint, component_id, kept)`` for every row: 16 hex digits, and the smallest id reachable by links.

    Null text and text without words have fingerprint zero and are linked like any other; equal
    fingerprints are one node, so copies cost nothing; repeated rows share a component; null ids never
    name a component unless it holds no other. ``kept`` is true for one row of each component, of the id
    that names it. ``keep`` names columns to carry along, in a struct ``row``; the others are not read.
    """
    fps = fingerprints(docs, id_col, text_col, words, keep).withColumn("row_no", F.monotonically_increasing_id())
    fps = materialise(fps, "fingerprints")  # once written, row numbers stay
    nodes = materialise(fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_no")).alias("least")), "nodes")
    n = nodes.count()
    columns = [F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept", *(["row"] if keep else [])]
    if not n:
        return fps.withColumn("component_id", F.col("id")).withColumn("kept", F.lit(True)).select(columns)
    labels = components(tile_links(nodes.select("fp"), n, radius))
    labelled = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = labelled.groupBy("label").agg(F.min("least").alias("head"))
    of_fp = materialise(labelled.join(named, "label").select("fp", F.col("head.id").alias("component_id"), F.col("head.row_no").alias("head_no")), "components")
    told = fps.select("id", "fp", "row_no").join(of_fp, "fp").withColumn("kept", F.col("row_no") == F.col("head_no"))
    if keep:  # rows meet by their number: a large component is no hot key for them
        told = told.drop("id", "fp").join(fps, "row_no")
    return told.select(columns)


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which texts have words, their distinct shingle hashes text by text, the text of each hash)."""
    have, h, counts = _shingle_hashes(texts, words)
    owner = np.repeat(have, counts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return have, h[new], owner[new]


def sketch_texts(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, second, n, least) of each text's set of shingles.

    Equal sets have equal keys (sums of mixed hashes), near ones 128-bit SimHash words ``first`` and ``second`` of
    few differing bits. ``n`` counts the set; ``least`` has its smallest hash in each of ``BANDS`` orders, which two
    sets share with a chance of their Jaccard. Texts without words have the empty set, with zero everywhere.
    """
    have, h, owner = shingle_sets(texts, words)
    key, first, second, n = (np.zeros(len(texts), t) for t in (np.uint64, np.uint64, np.uint64, np.int64))
    least = np.zeros((len(texts), BANDS), np.uint64)
    if len(have):
        counts = np.bincount(owner, minlength=len(texts))[have]
        starts, other = np.cumsum(counts) - counts, splitmix(h)
        with np.errstate(over="ignore"):
            key[have] = np.add.reduceat(splitmix(other ^ P1), starts)
            for b in range(BANDS):
                x = (h ^ P1 * np.uint64(b)) * (P2 + np.uint64(2 * b))
                x ^= x >> np.uint64(32)
                least[have, b] = np.minimum.reduceat(x * P3, starts)
        first[have], second[have], n[have] = majority(h, counts), majority(other, counts), counts
    return key, first, second, n, least


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, keep: list[str]) -> DataFrame:
    """``(id, key, first, second, n, least, row)``: the sketch of every whole text, and the columns ``keep``. No shuffle."""
    held = text_col in keep

    def run(batches):
        encoding.release()
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column("row").field(keep.index(text_col)) if held else batch.column("text"))
            got = [sketch_texts(texts[lo:hi], words) for lo, hi in slices_by_bytes([len(t) for t in texts], 1 << 21)]
            made = [np.concatenate(x).view(np.int64) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 4 + [np.zeros((0, BANDS), np.int64)]
            least = pa.ListArray.from_arrays(np.arange(0, BANDS * len(texts) + 1, BANDS, np.int32), made[4].reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, made[:4]), least, batch.column("row")], ["id", "key", "first", "second", "n", "least", "row"])

    chosen = docs.select(F.col(id_col).alias("id"), *([] if held else [F.col(text_col).alias("text")]), F.struct(*keep).alias("row"))
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *(StructField(c, LongType()) for c in ("key", "first", "second", "n")), StructField("least", ArrayType(LongType())), chosen.schema["row"]])
    return chosen.mapInArrow(run, schema)


def _close(home: dict, other: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): pairs of two tiles within the radius, of different labels, whose set sizes allow the Jaccard.

    Tiles are cut into strips of like population count; strips whose counts differ beyond the radius are skipped.
    """
    pops = [np.bitwise_count(t["first"]).astype(np.int64) for t in (home, other)]
    orders = [np.argsort(p, kind="stable") for p in pops]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(orders[0]), STRIP):
        a = orders[0][i : i + STRIP]
        for j in range(0, len(orders[1]), STRIP):
            b = orders[1][j : j + STRIP]
            if pops[0][a[0]] - pops[1][b[-1]] > NEAR_64 or pops[1][b[0]] - pops[0][a[-1]] > NEAR_64:
                continue
            x, y = np.nonzero(np.bitwise_count(home["first"][a][:, None] ^ other["first"][b][None, :]) <= NEAR_64)
            found.append((a[x], b[y]))
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    bits = np.bitwise_count(home["first"][x] ^ other["first"][y]).astype(np.int64) + np.bitwise_count(home["second"][x] ^ other["second"][y])
    m, n = home["n"][x], other["n"][y]
    fits = (bits <= NEAR_128) & (home["label"][x] != other["label"][y]) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
    return x[fits], y[fits]


def shared_shingles(a: list[bytes], b: list[bytes], x: np.ndarray, y: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(both, in a[x], in b[y]): how many distinct shingles each asked pair (a[x], b[y]) shares, and has.

    Products of 0/1 matrices of the texts asked for and the shingles that both sides hold count all pairs at once.
    """
    own, other = np.unique(x), np.unique(y)
    (_, ha, oa), (_, hb, ob) = shingle_sets([a[i] for i in own], words), shingle_sets([b[i] for i in other], words)
    n_a, n_b = np.bincount(oa, minlength=len(own)), np.bincount(ob, minlength=len(other))
    common = np.intersect1d(ha, hb)
    both = np.zeros((len(own), len(other)), np.float32)
    (ia, oa), (ib, ob) = ((np.searchsorted(common, h[keep]), o[keep]) for h, o in ((ha, oa), (hb, ob)) if (keep := np.isin(h, common)) is not None)
    orders = [np.argsort(i, kind="stable") for i in (ia, ib)]
    (ia, oa), (ib, ob) = (ia[orders[0]], oa[orders[0]]), (ib[orders[1]], ob[orders[1]])
    for lo in range(0, len(common), COLUMNS):
        sides = []
        for i, o, n in ((ia, oa, len(own)), (ib, ob, len(other))):
            p, q = np.searchsorted(i, [lo, lo + COLUMNS])
            one = np.zeros((n, min(COLUMNS, len(common) - lo)), np.float32)
            one[o[p:q], i[p:q] - lo] = 1
            sides.append(one)
        both += sides[0] @ sides[1].T
    x, y = np.searchsorted(own, x), np.searchsorted(other, y)
    return both[x, y].astype(np.int64), n_a[x], n_b[y]


_MEMBER = ("key", "first", "second", "n", "label")


def _members(column) -> list[dict]:
    """Each row's list of member structs as numpy columns; ``text`` (if any) as bytes."""
    flat, ends = column.flatten(), np.asarray(column.offsets)
    ends = (ends - ends[0]).tolist()
    arrays = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in _MEMBER}
    arrays = {c: v.view(np.uint64) if c in ("first", "second") else v for c, v in arrays.items()}
    texts = text_bytes(flat.field("text")) if flat.type.get_field_index("text") >= 0 else None
    return [{c: v[lo:hi] for c, v in arrays.items()} | ({} if texts is None else {"text": texts[lo:hi]}) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def _ask(percent: int):
    """Tiles that meet -> the places and keys of the members that have a candidate there."""

    def run(batches):
        encoding.release()
        import pyarrow as pa

        for batch in batches:
            for home, other, at, to in zip(_members(batch.column("members")), _members(batch.column("visitors")), *(batch.column(c).to_pylist() for c in ("at", "to")), strict=True):
                same = at == to
                x, y = _close(home, home if same else other, percent)
                asked = [(home["key"][np.unique(x)], to)] if same else [(home["key"][np.unique(x)], to), (other["key"][np.unique(y)], at)]
                keys = np.concatenate([k for k, _ in asked])
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([p for k, p in asked for _ in range(len(k))], pa.string()), pa.array(keys)], ["tile", "key"])

    return run


def _confirm(words: int, percent: int):
    """Tiles that meet, with texts -> links that connect what reaches the Jaccard there."""

    def run(batches):
        encoding.release()
        import pyarrow as pa

        for batch in batches:
            for home, other, at, to in zip(_members(batch.column("members")), _members(batch.column("visitors")), *(batch.column(c).to_pylist() for c in ("at", "to")), strict=True):
                other = home if at == to else other
                x, y = _close(home, other, percent)
                if at == to:  # a tile that meets itself has each pair twice
                    once = home["key"][x] < home["key"][y]
                    x, y = x[once], y[once]
                if not len(x):
                    continue
                both, m, n = shared_shingles(home["text"], other["text"], x, y, words)
                ok = 100 * both >= percent * (m + n - both)
                a, b = _forest(home["key"][x[ok]], other["key"][y[ok]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


_TILE = ("band", "low", "size", "part")


def place(nodes: DataFrame, bands: range) -> DataFrame:
    """Nodes ``(key, first, second, n, label, least)`` in tiles ``(band, low, size, part)``, of which none is large.

    A bucket holds what shares the smallest hash of a band; buckets of one node go. Large buckets are parted by
    set size, in steps of which a Jaccard of 0.8 can reach the next one only, then by hash.
    """
    spread = nodes.filter("n > 0").select(*_MEMBER, F.posexplode("least").alias("band", "low")).filter(F.col("band").isin(*bands))
    counts = spread.groupBy("band", "low").agg(F.count("*").alias("n_bucket"), F.sum("n").alias("weight")).filter("n_bucket > 1")
    met = spread.join(materialise(counts, "buckets"), ["band", "low"])  # written, so that a skewed side of this join can be split
    large = (F.col("n_bucket") > TILE) | (F.col("weight") > TILE_SHINGLES)
    size = F.when(large, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZE_STEP)))).otherwise(-1).cast("int")
    met = materialise(met.select(*_MEMBER, "band", "low", size.alias("size")), "buckets")
    sized = met.filter("size >= 0")
    parts = sized.groupBy("band", "low", "size").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("parts"))
    hot = sized.join(materialise(parts, "buckets"), ["band", "low", "size"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    small = met.filter("size < 0").withColumn("part", F.lit(0)).withColumn("parts", F.lit(1))
    return materialise(small.unionByName(hot.select(*small.columns)), "placed")


def meetings(placed: DataFrame, *more: str) -> DataFrame:
    """``(members, visitors, at, to)``: every two tiles of a bucket that may hold a link, once, and each with itself (no visitors)."""
    name = lambda size, part: F.concat_ws(",", F.col("band"), F.col("low"), size, part)
    tiles = lambda rows: rows.groupBy(*_TILE).agg(F.max("parts").alias("parts"), F.collect_list(F.struct(*_MEMBER, *more)).alias("members"))
    own = lambda found: found.select("members", F.lit(None).cast(found.schema["members"].dataType).alias("visitors"), name(F.col("size"), F.col("part")).alias("at"), name(F.col("size"), F.col("part")).alias("to"))
    alone = own(tiles(placed.filter("size < 0")))
    several = materialise(tiles(placed.filter("size >= 0")), "tiles")
    if several.isEmpty():
        return alone
    sizes = several.groupBy("band", "low", "size").agg(F.max("parts").alias("there"))
    ahead = several.join(sizes.withColumn("size", F.col("size") - 1), ["band", "low", "size"], "left")
    parts_of = lambda size, least, until: F.when(least < until, F.transform(F.sequence(least, F.greatest(until - 1, least)), lambda p: F.struct(size.alias("size"), p.alias("part"))))
    nothing = F.array().cast("array<struct<size:int,part:int>>")
    to = F.concat(F.coalesce(parts_of(F.col("size"), F.col("part") + 1, F.col("parts")), nothing), F.coalesce(parts_of(F.col("size") + 1, F.lit(0), F.coalesce("there", F.lit(0))), nothing))
    visits = ahead.select("band", "low", F.explode(to).alias("goal"), F.col("members").alias("visitors"), name(F.col("size"), F.col("part")).alias("at")).select("band", "low", "goal.size", "goal.part", "visitors", "at")
    crossed = several.select(*_TILE, "members").join(visits, list(_TILE)).select("members", "visitors", "at", name(F.col("size"), F.col("part")).alias("to"))
    return alone.unionByName(own(several)).unionByName(crossed)


def confirmed_links(nodes: DataFrame, texts_of, bands: range, words: int, percent: int) -> DataFrame:
    """``(a, b)``: links of keys of different labels that reach the Jaccard; ``texts_of``: keys to ``(key, text)``.

    Sketches meet first; only texts that have a candidate in a tile travel, once for each tile.
    """
    placed = place(nodes, bands)
    asked = materialise(meetings(placed).mapInArrow(_ask(percent), "tile string, key long").distinct(), "asked")
    held = placed.withColumn("tile", F.concat_ws(",", *_TILE)).join(asked, ["tile", "key"])
    with_text = materialise(held.join(texts_of(asked.select("key").distinct()), "key").select(*placed.columns, "text"), "asked-texts")
    return meetings(with_text, "text").mapInArrow(_confirm(words, percent), "a long, b long").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, keep: list[str] | None = None) -> DataFrame:
    """``(id, component_id, kept, row)``: as ``near_groups``, of texts whose shingle sets have a Jaccard of ``percent`` / 100 or more.

    Texts that share one of ``BANDS`` smallest shingle hashes (of a Jaccard of 0.8, all but one pair in 390,000)
    meet in tiles; there SimHash words of 128 bits name candidates by xor and bit counts, and the texts' own
    shingles decide, so unlike texts never share a link. The first band runs alone and links most of a large
    group; then only texts of different components are compared further. Null text, and text without words,
    are one group; equal sets are one node; repeated rows and null ids as in ``near_groups``.
    """
    if percent < 80:
        raise ValueError("sketches, bands and size steps are laid out for 80 percent or more")
    rows = sketches(docs, id_col, text_col, words, keep or docs.columns).withColumn("row_no", F.monotonically_increasing_id())
    rows = materialise(rows, "sketches")  # once written, row numbers stay
    heads = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_no")).alias("least_row")
    nodes = materialise(rows.groupBy("key").agg(heads, *(F.min(c).alias(c) for c in ("first", "second", "n", "least"))), "nodes")
    texts_of = lambda keys: keys.join(nodes.select("key", F.col("least_row.row_no").alias("row_no")), "key").join(rows.select("row_no", F.col(f"row.{text_col}").alias("text")), "row_no").select("key", "text")
    labels, links = None, None
    for bands in (range(1), range(1, BANDS)):
        own = _labelled(nodes, labels)
        found = materialise(confirmed_links(own, texts_of, bands, words, percent), "confirmed")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links, "a", "b")
    labelled = _labelled(nodes, labels)
    named = labelled.groupBy("label").agg(F.min("least_row").alias("head"))
    of_key = materialise(labelled.join(named, "label").select("key", F.col("head.id").alias("component_id"), F.col("head.row_no").alias("head_no")), "components")
    told = rows.select("key", "row_no").join(of_key, "key").select("row_no", "component_id", (F.col("row_no") == F.col("head_no")).alias("kept"))
    return told.join(rows.select("id", "row", "row_no"), "row_no").select(F.col("id").alias(id_col), "component_id", "kept", "row")


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("label", F.col("key"))
    return nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
