"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import WORD, materialise

WEIGHTS = (5, 2, 1)
MOST = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, n_docs, target)``: what each source gives to a mix as large as all sources together.

    Sources by code point, null last, weigh ``weights`` in turn. Targets stop at ``most`` times a source's
    size and the excess is shared again by weight: in order of size against weight, those at their limit
    come first, so one running sum finds the level at which the rest share. One row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight.cast("long"))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto, all_rows = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, before = F.sum("source_size").over(all_rows), F.coalesce(F.sum(F.col("source_size") * most).over(upto), F.lit(0))
    left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    levels = weighed.withColumn("level", (total - before) / left).withColumn("capped", F.col("source_size") * most <= F.col("level") * F.col("weight"))
    # the first source below its limit sets the level for all that follow
    open_level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(Window.partitionBy(F.lit(1)))
    return levels.withColumn("shared", open_level["level"] * F.col("weight")).select("source", "source_size", "n_docs", F.when(F.col("capped") | F.col("shared").isNull(), (F.col("source_size") * most).cast("double")).otherwise(F.col("shared")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``(id, size, source_size, target, copies, taken)`` for every row, ``taken`` being the words the mix takes.

    Size is the number of words (null text: 0). A document is expected target / source_size times, and
    copies follow from the running sum of that within its source, plus one random offset: one copy for each
    integer passed. The order within a source runs by size class (eight for each doubling), then by a hash of
    the id, then by size and id, so every size is sampled evenly. Offset and order depend on ``seed`` and ids
    only: reruns agree. Sources without words have target 0. Null sources form one source; null ids come first;
    repeated rows are taken one by one. ``keep`` names columns to carry along, in a struct ``row`` (whatever
    they are called), whose hash decides among rows equal in id and size; the others are not read.

    Words are counted once. Rows are sorted by ranges of the whole order, so a source with a third of all rows
    is many partitions; only each partition's count for each source is summed up before it.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    row, tie = (F.struct(*keep), F.xxhash64(*keep)) if keep else (F.lit(None).cast("string"), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"), size.alias("size"), row.alias("row"), tie.alias("tie"))
    rows = materialise(rows, "sizes")
    octave = F.concat(F.lpad(F.length(F.bin("size")).cast("string"), 2, "0"), F.substring(F.bin("size"), 1, 4))
    salt = F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 1)
    order = ["no_source", "name", "octave", "salt", "size", "id", "tie"]
    ordered = rows.withColumn("octave", octave).withColumn("salt", salt).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # partition number, then place in it
    placed = materialise(ordered.select("id", "no_source", "name", "size", "row", at.alias("at")), "ordered").withColumn("part", F.shiftright("at", 33))
    groups = placed.groupBy("part", "no_source", "name").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("no_source", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that holds the source
    starts = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "no_source", "name", "before", "first")
    sources = source_targets(groups.select(F.when(~F.col("no_source"), F.col("name")).alias("source"), "size"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("null"))).cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    sources = sources.withColumn("rate", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))).withColumn("offset", offset)
    sources = sources.withColumn("no_source", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).select("no_source", "name", "source_size", "target", "rate", "offset")
    known = materialise(starts.join(sources, ["no_source", "name"]), "starts")
    joined = placed.join(known, ["part", "no_source", "name"]).withColumn("k", (F.col("before") + F.col("at") - F.col("first") + 1).cast("double"))
    passed = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    copies = (passed(F.col("k")) - passed(F.col("k") - 1)).cast("long")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *([F.col("row")] if keep else []))
