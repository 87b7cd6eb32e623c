"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt into blocks; each block is evolved on several islands. A chromosome is a list of bins,
and the unit of inheritance is the whole bin: crossover injects well-filled bins of one parent into the
other, drops the bins that hold duplicates of injected pieces, and best-fits what they displace. After
every epoch each island's elite moves to the next island. What ends in poorly filled bins is pooled over
all blocks and packed once more in the same way.
"""

from __future__ import annotations

import bisect
import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import local_file, materialise, partitions, slices_by_bytes, text_bytes
from claimloom.llm.encoding import encoder

#: Pieces in a block; islands of each; epochs with a migration between; individuals.
BLOCK, ISLANDS, EPOCHS, POPULATION = 16_384, 2, 2, 6
#: Pieces that the children of an epoch may hold, all together, where a block isn't yet as few bins as its lengths allow; of the first pass, and of the pass over poorly filled bins: 61 children of 16,384 pieces, 1,000 of 1,000.
GENERATION_PIECES, LAST_GENERATION_PIECES = 1_000_000, 1_000_000
#: Bins filled to less than this share are packed again over all blocks.
WELL_FILLED = 0.97


def best_fit(order, lens: list[int], cap: int, bins: list[tuple], free: list[int]) -> None:
    """Puts pieces, in the given order, each into the fullest bin with room for it, or a new one; changes bins and free."""
    stacks: list[list[int]] = [[] for _ in range(cap + 1)]
    mask = 0
    for b, f in enumerate(free):
        stacks[f].append(b)
        mask |= 1 << f
    for i in order:
        size = lens[i]
        room = mask >> size
        if room:
            f = size + (room & -room).bit_length() - 1
            b = stacks[f].pop()
            if not stacks[f]:
                mask ^= 1 << f
            bins[b] += (i,)
        else:
            f, b = cap, len(bins)
            bins.append((i,))
            free.append(0)
        free[b] = f - size
        stacks[f - size].append(b)
        mask |= 1 << (f - size)


def fitness(free: list[int], cap: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, as the mean square of the fills."""
    fills = 1 - np.array(free) / cap
    return -len(free), float(np.mean(fills * fills)) if len(free) else 1.0


def exchange(displaced: list[int], lens: list[int], cap: int, bins: list[tuple], free: list[int]) -> list[int]:
    """Fills bins with longer displaced pieces, each in place of one or two shorter ones, which are displaced instead; changes bins and free."""
    waiting = sorted((lens[i], i) for i in displaced)
    for b in sorted((b for b, f in enumerate(free) if f), key=free.__getitem__):
        best = None
        for out in (*((i,) for i in bins[b]), *itertools.combinations(bins[b], 2)):
            size = sum(lens[i] for i in out)
            at = bisect.bisect_right(waiting, (size + free[b], len(lens))) - 1
            if at >= 0 and waiting[at][0] > size and (best is None or waiting[at][0] - size > best[0]):
                best = (waiting[at][0] - size, at, out)
        if best:
            gain, at, out = best
            bins[b] = (*(i for i in bins[b] if i not in out), waiting.pop(at)[1])
            free[b] -= gain
            for i in out:
                bisect.insort(waiting, (lens[i], i))
    return [i for _, i in reversed(waiting)]


def crossover(one, two, lens: list[int], cap: int, rng) -> tuple[list[tuple], list[int]]:
    """A child of ``one`` with whole well-filled bins of ``two``; the worst bins of ``one`` are opened as well, and what is displaced may take the place of shorter pieces."""
    (bins, free), (other, other_free) = one, two
    owner = np.empty(len(lens), np.int64)
    for b, items in enumerate(bins):
        for i in items:
            owner[i] = b
    order = np.argsort(np.array(other_free), kind="stable")
    good = order[: max(1, len(order) // 2)]
    injected = rng.choice(good, max(1, len(good) // 4), replace=False)
    taken, hit = set(), set()
    for b in injected.tolist():
        for i in other[b]:
            taken.add(i)
            hit.add(int(owner[i]))
    worst = np.argsort(-np.array(free), kind="stable")[: max(2, len(free) // 10)]
    hit.update(worst[rng.random(len(worst)) < 0.5].tolist())
    displaced = [i for b in hit for i in bins[b] if i not in taken]
    kept = [b for b in range(len(bins)) if b not in hit]
    child = [bins[b] for b in kept] + [other[b] for b in injected.tolist()]
    child_free = [free[b] for b in kept] + [other_free[b] for b in injected.tolist()]
    best_fit(exchange(displaced, lens, cap, child, child_free), lens, cap, child, child_free)
    return child, child_free


def evolve(lens: np.ndarray, cap: int, elites: list[np.ndarray], seed: int, pieces: int = GENERATION_PIECES) -> list[np.ndarray]:
    """One epoch: the population after it, best first, each as the bin number of every piece.

    A block whose best packing has as few bins as its lengths allow needs no generation; any other gets as many
    children as hold about ``pieces`` pieces. The population starts from several orders of the same pieces.
    """
    sizes, rng = lens.tolist(), np.random.default_rng(seed)
    least = -(-int(lens.sum()) // cap)
    people = []
    for assigned in elites:
        bins: list[list[int]] = [[] for _ in range(int(assigned.max()) + 1 if len(assigned) else 0)]
        for i, b in enumerate(assigned.tolist()):
            bins[b].append(i)
        people.append(([tuple(x) for x in bins], [cap - sum(sizes[i] for i in x) for x in bins]))
    while len(people) < POPULATION:  # decreasing length, and the same with some noise in the order
        noise = rng.normal(0, 0.02 * cap * len(people), len(lens)) if people else 0
        person: tuple[list, list] = ([], [])
        best_fit(np.argsort(-(lens + noise), kind="stable").tolist(), sizes, cap, *person)
        people.append(person)
        if len(person[0]) <= least:
            break
    rank = lambda p: fitness(p[1], cap)
    people.sort(key=rank, reverse=True)
    for _ in range(pieces // max(len(sizes), 1)):
        if len(people[0][0]) <= least or len(people) < 2:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        people.append(crossover(people[a], people[b], sizes, cap, rng))
        people.sort(key=rank, reverse=True)
        del people[POPULATION:]
    out = []
    for bins, _ in people:
        assigned = np.empty(len(lens), np.int32)
        for b, items in enumerate(bins):
            assigned[list(items)] = b
        out.append(assigned)
    return out


def _epoch(cap: int, number: int, generation: int):
    def run(batches):
        for pdf in batches:
            elites, scores = [], []
            for block, island, lens, before in zip(pdf.block, pdf.island, pdf.lens, pdf.elites, strict=True):
                sizes = np.frombuffer(lens, np.int32)
                given = list(dict.fromkeys(before)) if before is not None else []
                people = evolve(sizes, cap, [np.frombuffer(e, np.int32) for e in given], hash((int(block), int(island), number)) & 0x7FFFFFFF, generation)
                elites.append([p.tobytes() for p in people])
                fills = np.bincount(people[0], sizes, int(people[0].max()) + 1) if len(sizes) else np.zeros(0)
                score = fitness((cap - fills).tolist(), cap)
                scores.append(score[0] + score[1])
            yield pdf.assign(elites=elites, score=scores)[["block", "island", "lens", "elites", "score"]]

    return run


def _opened(cap: int):
    """(items, best assignment) of a block -> its pieces with bin, offset and the bin's free room."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                items = batch.column("items")[k].values
                lens = items.field("length").to_numpy()
                bins = np.frombuffer(batch.column("best")[k].as_py(), np.int32).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lens[order])
                starts = ends - lens[order]
                first = np.searchsorted(bins[order], bins[order], "left")
                offset = np.empty(len(lens), np.int64)
                offset[order] = starts - starts[first]
                room = cap - np.bincount(bins, lens).astype(np.int64)[bins]
                block = pa.array(np.full(len(lens), batch.column("block")[k].as_py()), pa.int64())
                cols = [*(items.field(n) for n in _ITEM), block, pa.array(bins), pa.array(offset), pa.array(room)]
                yield pa.RecordBatch.from_arrays(cols, [*_ITEM, "block", "bin", "offset", "room"])

    return run


_ITEM = ("length", "doc_id", "piece", "start", "ids_crc32", "row_no")


def pack_pieces(pieces: DataFrame, n: int, cap: int, generation: int = GENERATION_PIECES) -> DataFrame:
    """Assigns pieces shorter than ``cap`` to bins, block by block; n: their number."""
    spark = pieces.sparkSession
    blocks = max(-(-n // BLOCK), min(8, -(-n // 256)), 1)
    item = F.struct(*_ITEM)
    dealt = pieces.groupBy(F.pmod(F.xxhash64("row_no"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    dealt = materialise(dealt, "pack-blocks")

    @F.pandas_udf("binary")
    def packed(lens):
        return lens.map(lambda x: np.asarray(x, np.int32).tobytes())

    schema = "block long, island int, lens binary, elites array<binary>, score double"
    lens = packed(F.transform("items", lambda x: x["length"]))
    islands = dealt.select("block", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), lens.alias("lens"), F.lit(None).cast("array<binary>").alias("elites"))
    tasks = max(1, min(partitions(spark) * 4, blocks * ISLANDS))
    for number in range(EPOCHS):
        evolved = materialise(islands.repartition(tasks, "block", "island").mapInPandas(_epoch(cap, number, generation), schema), "pack-epoch")
        if number + 1 < EPOCHS:
            moved = evolved.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), "lens", F.slice("elites", 1, 1).alias("elites"))
            islands = evolved.select("block", "island", "lens", "elites").unionByName(moved).groupBy("block", "island").agg(F.first("lens").alias("lens"), F.flatten(F.array_sort(F.collect_list("elites"))).alias("elites"))
    best = evolved.groupBy("block").agg(F.max_by(F.col("elites")[0], F.struct("score", -F.col("island"))).alias("best"))
    return dealt.join(best, "block").mapInArrow(_opened(cap), "length long, doc_id long, piece int, start long, ids_crc32 long, row_no long, block long, bin long, offset long, room long")


def _pieces(tokenizer: str, end_id: int, cap: int):
    def run(batches):
        import pyarrow as pa

        enc = encoder(local_file(tokenizer))
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for lo, hi in slices_by_bytes([len(t) for t in texts], 1 << 22):
                rows = []
                for doc_id, short in zip(doc_ids[lo:hi], enc.encode([t.decode() for t in texts[lo:hi]], end_id), strict=True):
                    ids = short.astype("<u4")
                    first = len(ids) % cap or cap
                    for piece, a in enumerate([0, *range(first, len(ids), cap)]):
                        b = first if not piece else a + cap
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b])))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, cap: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row for each piece.

    A document's ids, with the end id, stay whole up to ``cap``; longer ones are cut, the first piece taking
    the remainder. Null text counts as empty (one id); an empty table gives no rows; repeated rows and null
    ids are pieces of their own; other columns are not read. Full pieces are sequences by themselves.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = chosen.mapInArrow(_pieces(tokenizer, end_id, cap), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = materialise(pieces.withColumn("row_no", F.monotonically_increasing_id()), "pieces")  # once written, row numbers stay
    full, part = pieces.filter(F.col("length") == cap), pieces.filter(F.col("length") < cap)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    own = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(columns)
    n = part.count()
    if not n:
        return own
    once = materialise(pack_pieces(part, n, cap), "packed")
    loose = once.filter(F.col("room") > (1 - WELL_FILLED) * cap)
    kept = once.filter(F.col("room") <= (1 - WELL_FILLED) * cap).withColumn("sequence_id", F.col("block") * (1 << 32) + F.col("bin")).select(columns)
    again = loose.count()
    if not again:
        return own.unionByName(kept)
    second = pack_pieces(loose.select(*_ITEM), again, cap, LAST_GENERATION_PIECES)
    return own.unionByName(kept).unionByName(second.withColumn("sequence_id", (F.col("block") + (1 << 29)) * (1 << 32) + F.col("bin")).select(columns))
