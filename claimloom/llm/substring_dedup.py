"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Tasks hash every window of their documents by prefix sums of a polynomial modulo 2**64, keep one entry
for each hash (with the smallest id of a slice of documents), and send these to buckets, packed. Buckets
find hashes that start in a smaller document; the verdicts go to the documents, where removed windows
merge into maximal intervals. Partitions grow in number with the bytes of all texts, and what a partition
holds is cut into parts that come in order, sorted by Spark: a task keeps one part's entries or verdicts.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import partitions, slices_by_bytes, splitmix, text_bytes

SLICE = 3 << 20
#: Bytes of text for each part of a partition, and the most partitions of an exchange; beyond these, parts grow in number.
PART_BYTES, MOST_PARTITIONS = 32 << 20, 1 << 16
_NULL = -(1 << 63)
_rng = np.random.default_rng(13)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASES = tuple(int(x) | 1 for x in _rng.integers(0, 1 << 63, 2, dtype=np.int64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) and the inverses, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            out.append(p)
        _powers[base] = tuple(out)
    return _powers[base]


def _rolling(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values times powers, and the inverse powers: the hash of [a, b) is (c[b] - c[a]) * inv[a]."""
    power, inverse = _power(base, len(values) + 1)
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=c[1:])
    return c, inverse


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of a buffer, in parts that end at white space."""
    starts, hashes, lo = [], [], 0
    u8 = np.frombuffer(buf, np.uint8)
    while lo < len(buf):
        hi = lo + SLICE
        if hi < len(buf):
            gap = np.flatnonzero(_SPACE[u8[hi : hi + SLICE]])
            hi = hi + int(gap[0]) if len(gap) else len(buf)
        part = u8[lo:hi]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[part], [True]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        c, inverse = _rolling(_BYTE[part], _BASES[0])
        starts.append(a + lo)
        hashes.append(splitmix((c[b] - c[a]) * inverse[a]))
        lo = hi
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def window_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every window in texts, and each text's number of words."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts, words = word_hashes(b" ".join(texts))
    n_words = np.bincount(np.searchsorted(np.cumsum(sizes), starts, "right"), minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    c, inverse = _rolling(words, _BASES[1])
    n = np.maximum(n_words - width + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) + np.repeat(np.cumsum(n_words) - n_words - (np.cumsum(n) - n), n)
    return splitmix((c[at + width] - c[at]) * inverse[at]), owner, n_words


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _low(hashes: np.ndarray) -> np.ndarray:
    """The part of a hash that travels: 56 bits; the bucket holds the rest of what tells hashes apart."""
    return hashes & np.uint64((1 << 56) - 1)


def _pack(ids: np.ndarray, low: np.ndarray) -> bytes:
    """Entries (id, hash), sorted by id here: the ids as deflated runs, then 7 bytes of each hash."""
    order = np.argsort(ids, kind="stable")
    own, counts = np.unique(ids, return_counts=True)
    head = zlib.compress(np.diff(own, prepend=0).tobytes() + counts.astype(np.int64).tobytes(), 1)
    body = np.ascontiguousarray(low[order]).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
    return len(head).to_bytes(4, "little") + head + body


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(payload[:4], "little")
    head = np.frombuffer(zlib.decompress(payload[4 : 4 + size]), np.int64)
    own, counts = np.cumsum(head[: len(head) // 2]), head[len(head) // 2 :]
    body = np.zeros((int(counts.sum()), 8), np.uint8)
    body[:, :7] = np.frombuffer(payload[4 + size :], np.uint8).reshape(-1, 7)
    return np.repeat(own, counts), body.reshape(-1).view(np.uint64)


def _mine(ids: np.ndarray, to: int) -> np.ndarray:
    """Which of ``to`` parts a document is in."""
    return (splitmix(ids.view(np.uint64)) % np.uint64(to)).astype(np.int64)


_MESSAGE = ["to", "part", "stage", "payload"]
_SCHEMA = "`to` int, part int, stage int, payload binary"


def _messages(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], _MESSAGE)


def _verdicts(ids: np.ndarray, low: np.ndarray, to: int, parts: int) -> list[tuple]:
    """Windows to remove, as one message (stage 1) for each part of documents."""
    mine = _mine(ids, to * parts)
    order = np.argsort(mine, kind="stable")
    cuts = np.flatnonzero(np.diff(mine[order], prepend=-1))
    return [(*divmod(int(mine[order[a]]), parts), 1, _pack(ids[order[a:b]], low[order[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]


def _ids(column) -> np.ndarray:
    return np.array([_NULL if x is None else x for x in column.to_pylist()], np.int64)


def _collect(width: int, to: int, parts: int):
    """Documents -> stage 0 messages (hash entries by bucket), and verdicts that a slice settles itself."""

    buckets = to * parts

    def run(batches):
        for batch in batches:
            ids, texts = _ids(batch.column(0)), text_bytes(batch.column(1))
            for lo, hi in slices_by_bytes([len(t) for t in texts], SLICE):
                hashes, owner, _ = window_hashes(texts[lo:hi], width)
                if not len(hashes):
                    continue
                order = np.argsort(hashes, kind="stable")
                hashes, mine = hashes[order], ids[lo:hi][owner[order]]
                new = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]) != 0)
                least = np.minimum.reduceat(mine, new)
                later = mine > np.repeat(least, np.diff([*new, len(hashes)]))
                rows = _verdicts(mine[later], _low(hashes[later]), to, parts) if later.any() else []
                hashes = hashes[new]
                bounds = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
                low = _low(hashes)
                rows += [(*divmod(k, parts), 0, _pack(least[a:b], low[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
                yield _messages(rows)

    return run


def _settle(to: int, parts: int):
    """Stage 0 messages, bucket after bucket -> verdicts for all but the smallest document of each hash; others pass."""

    def settled(payloads: list[bytes]):
        both = [_unpack(p) for p in payloads]
        ids, low = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
        order = np.argsort(low, kind="stable")
        ids, low = ids[order], low[order]
        new = np.flatnonzero(np.diff(low, prepend=~low[:1]) != 0)
        later = ids > np.repeat(np.minimum.reduceat(ids, new), np.diff([*new, len(low)]))
        if later.any():
            yield _messages(_verdicts(ids[later], low[later], to, parts))

    def run(batches):
        now, held = None, []
        for batch in batches:
            passed = []
            for key, part, stage, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stage:
                    passed.append((key, part, stage, payload))
                    continue
                if held and (key, part) != now:
                    yield from settled(held)
                    held = []
                now = key, part
                held.append(payload)
            if passed:
                yield _messages(passed)
        if held:
            yield from settled(held)

    return run


def _intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal word intervals [a, b) that the windows at these ascending starts cover; touching ones are one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[[0, *(cut + 1)]].tolist(), (starts[[*cut, len(starts) - 1]] + width).tolist(), strict=True))


def _left(part: list[tuple], named: np.ndarray, wanted: np.ndarray, width: int):
    """What is left of some documents; ``wanted`` has the hashes of the verdicts mixed with their ids, sorted."""
    import pyarrow as pa

    keys = np.array([_NULL if d is None else d for d, _ in part], np.int64)
    touched = np.flatnonzero(np.isin(keys, named))
    found: dict[int, np.ndarray] = {}
    if len(touched):
        hashes, owner, _ = window_hashes([part[i][1] for i in touched], width)
        mixed = splitmix(_low(hashes) ^ splitmix(keys[touched].view(np.uint64))[owner])
        at = np.searchsorted(wanted, mixed)
        hit = wanted[np.minimum(at, len(wanted) - 1)] == mixed
        first = np.searchsorted(owner, np.arange(len(touched)))
        place = np.flatnonzero(hit)
        own = owner[place]
        cuts = np.searchsorted(own, np.arange(len(touched) + 1))
        found = {int(i): place[a:b] - first[k] for k, (i, a, b) in enumerate(zip(touched, cuts[:-1], cuts[1:], strict=True)) if b > a}
    rows = []
    for i, (doc_id, text) in enumerate(part):
        words = text.split()  # of bytes: exactly 0x20 and 0x09 to 0x0D
        n, spans = len(words), _intervals(found[i], width) if i in found else []
        for a, b in reversed(spans):
            del words[a:b]
        kept = b" ".join(words)
        rows.append((doc_id, n, n - len(words), spans, kept.decode(), hashlib.sha256(kept).hexdigest()))
    cols = list(zip(*rows, strict=True))
    spans = pa.array([[{"first": a, "until": b} for a, b in x] for x in cols[3]], pa.list_(pa.struct([("first", pa.int64()), ("until", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), spans, pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text", "kept_sha256"])


def _remove(width: int):
    """Part after part, verdicts and then their documents -> what is left of each; keeps one part's verdicts and a slice of texts."""

    def run(batches):
        now, verdicts, named, wanted = None, [], np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            _, part, stage, payload, doc_id, text = batch.columns
            parts, stages, payloads, ids, texts = part.to_pylist(), stage.to_pylist(), payload.to_pylist(), doc_id.to_pylist(), text_bytes(text)
            lo = 0
            while lo < len(parts):  # runs of one part and stage
                hi = lo + 1
                while hi < len(parts) and (parts[hi], stages[hi]) == (parts[lo], stages[lo]):
                    hi += 1
                if parts[lo] != now:
                    now, verdicts, named, wanted = parts[lo], [], np.zeros(0, np.int64), np.zeros(0, np.uint64)
                if stages[lo] == 1:
                    verdicts += payloads[lo:hi]
                else:
                    if verdicts:
                        both, verdicts = [_unpack(p) for p in verdicts], []
                        named = np.unique(np.concatenate([x[0] for x in both]))
                        wanted = np.unique(np.concatenate([splitmix(low ^ splitmix(own.view(np.uint64))) for own, low in both]))
                    for a, b in slices_by_bytes([len(t) for t in texts[lo:hi]], SLICE):
                        yield _left(list(zip(ids[lo + a : lo + b], texts[lo + a : lo + b], strict=True)), named, wanted, width)
                lo = hi

    return run


def _address(to: int, parts: int):
    """Documents -> stage 2 messages; rows of null ids, which no verdict names, go anywhere."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = batch.num_rows
            ids, spread = _ids(batch.column(0)), np.arange(seen, seen + rows)
            mine = _mine(np.where(ids == _NULL, spread, ids), to * parts)
            seen += rows
            yield pa.RecordBatch.from_arrays([pa.array(mine // parts, pa.int32()), pa.array(mine % parts, pa.int32()), pa.array(np.full(rows, 2), pa.int32()), pa.nulls(rows, pa.binary()), *batch.columns], [*_MESSAGE, "doc_id", "text"])

    return run


def _layout(least: int, n_bytes: int) -> tuple[int, int]:
    """Partitions of the exchanges, and parts of each, for so many bytes of text."""
    whole = -(-n_bytes // PART_BYTES)
    to = max(least, min(whole, MOST_PARTITIONS), 1)
    return to, max(-(-whole // to), 1)


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, spans, kept_text, kept_sha256)``, one row for each input row.

    Removes each word that a window of ``width`` words covers whose sequence also starts in a document with
    a smaller id. ``spans`` are the maximal removed word intervals [first, until). Null text has no words;
    texts shorter than the width lose nothing; rows that repeat an id don't remove from each other; a null
    id is smaller than any other; other columns are not read. Hashes have 64 bits; equal hashes count as
    equal sequences. Memory of a task: its bucket's entries (7 bytes for each distinct window of a slice
    of documents, so a sequence that all documents share is one entry a slice), or the verdicts on one
    part of the documents and a slice of texts. Rows of null ids lose nothing and are dealt out evenly;
    rows that repeat one id have the same verdicts and pass through one task, one slice after the other.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, parts = _layout(partitions(docs.sparkSession), chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    entries = chosen.mapInArrow(_collect(width, n, parts), _SCHEMA)
    buckets = entries.repartitionById(n, F.col("to")).sortWithinPartitions("to", "part", "stage")
    verdicts = buckets.mapInArrow(_settle(n, parts), _SCHEMA)
    sent = verdicts.select(*_MESSAGE, F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))

    texts = chosen.mapInArrow(_address(n, parts), _SCHEMA + ", doc_id long, text string")
    together = sent.union(texts).repartitionById(n, F.col("to")).sortWithinPartitions("part", "stage")
    out = together.mapInArrow(_remove(width), "doc_id long, n_words long, n_removed long, spans array<struct<first: long, until: long>>, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
