"""Exact dedup by progressive refinement: length, then prefix hash, then full hash, each for surviving groups only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import SPACES, materialise

PREFIX = 64
#: Bits of the survivors' bitmap: 256 rows of 4 KB, whatever the input's size.
BITS = 256 * 32_768
#: A group is hot if it holds over one in this many survivors, so there are fewer hot groups than this.
HOT = 1000


def normalised(text) -> "F.Column":
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", " ")


def _keys(text):
    norm = normalised(text)
    return F.length(norm).cast("long").alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``(id, keep_id, group_size, kept, full_hash)``, one row for each input row.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty.
    ``full_hash`` (sha-256, hex) is null where length or prefix already tell a text from all others, unless
    ``hash_all`` asks for the hash of those as well; they still stay out of the last grouping. The smallest id's row stays; of rows that repeat that id and text just one does (null ids count as
    smallest). ``keep`` names columns to carry along, in a struct ``row``; the others are not read.

    Refinement: (1) count lengths; (2) where a length repeats, count (length, prefix hash); (3) where that
    repeats, hash the full text. The second scan finds the survivors by a bitmap of fixed size over
    (length, prefix) hashes, so no text is shuffled; a false positive costs a hash and changes nothing.
    Hot groups, fewer than ``HOT`` whatever the input, meet their rows by broadcast, the others by a shuffle,
    so no task gets a large group's rows.
    """
    narrow = docs.select(*_keys(F.col(text_col)))
    by_prefix = materialise(narrow.groupBy("len", "prefix").count(), "length-prefix")
    lengths = by_prefix.groupBy("len").agg(F.sum("count").alias("n")).filter("n > 1").select("len")
    alive = by_prefix.filter("count > 1").join(lengths, "len", "left_semi")
    slot = F.pmod(F.xxhash64("len", "prefix"), F.lit(BITS))
    bitmap = alive.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    bitmap = materialise(bitmap, "alive")

    row = [F.struct(*keep).alias("row")] if keep else []
    second = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row, *_keys(F.col(text_col))).withColumn("slot", slot)
    held = second.withColumn("bucket", F.expr("bitmap_bucket_number(slot)")).join(F.broadcast(bitmap), "bucket", "left")
    byte = "cast(conv(hex(substring(bits, cast(bitmap_bit_position(slot) div 8 AS int) + 1, 1)), 16, 10) AS int)"
    maybe = F.expr(f"bits IS NOT NULL AND getbit({byte}, cast(bitmap_bit_position(slot) % 8 AS int)) = 1")
    carried = ["row"] if keep else []
    hashed = materialise(held.select("id", "len", "prefix", *carried, maybe.alias("survives"), F.when(maybe | F.lit(hash_all), F.sha2(normalised(F.col("text")), 256)).alias("full_hash")), "refined")

    survivors = hashed.filter("survives")
    groups = survivors.groupBy("full_hash").agg(F.min("id").alias("least"), F.count("id").alias("named"), F.count("*").alias("group_size"))
    groups = groups.withColumn("keep_id", F.when(F.col("named") == F.col("group_size"), F.col("least"))).drop("least", "named")
    groups = materialise(groups, "groups")
    hot = groups.filter(F.col("group_size") * HOT > survivors.count()).select("full_hash", F.struct("keep_id", "group_size").alias("hot"))
    tagged = survivors.join(F.broadcast(hot), "full_hash", "left")
    met = tagged.filter("hot IS NOT NULL").withColumns({"keep_id": F.col("hot.keep_id"), "group_size": F.col("hot.group_size")})
    joined = met.unionByName(tagged.filter("hot IS NULL").join(groups, "full_hash")).drop("hot")
    first = F.row_number().over(Window.partitionBy("full_hash", "id").orderBy("len"))
    heads = joined.filter(F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("kept", first == 1)
    rest = joined.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    columns = [F.col("id").alias(id_col), F.col("keep_id"), F.col("group_size"), F.col("kept"), F.col("full_hash"), *carried]
    single = hashed.filter("NOT survives").select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("full_hash"), *carried)
    return single.unionByName(heads.unionByName(rest).select(columns))
