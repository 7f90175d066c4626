"""Sharding by jump consistent hashing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The multiplier of the published algorithm, 2862933555777941757, as high and low 32 bits.
MUL_HI, MUL_LO = divmod(2862933555777941757, 1 << 32)
MASK = (1 << 32) - 1
#: Chunks in which a shard numbers its rows: a shard's largest task has this part of its rows.
CHUNKS = 4096
#: Jumps that all rows try; the few that need more go on up to the number of shards.
FIRST_JUMPS = 12


def stable_key(id_col: Column) -> tuple[Column, Column, Column]:
    """Two unsigned 32-bit halves of the jump key and a chunk number, from MD5 of the id as text."""
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")))

    def number(at: int, digits: int) -> Column:
        return F.conv(F.substring(digest, at, digits), 16, 10).cast("bigint")

    return number(1, 8), number(9, 8), number(17, 3)


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MUL + 1 modulo 2**64 from 32-bit halves; no product exceeds a signed 64-bit integer."""
    m1, m0 = MUL_LO >> 16, MUL_LO & 0xFFFF
    low = lo * m0 + 1
    mid = lo * m1 + F.shiftright(low, 16)
    new_lo = F.shiftleft(mid.bitwiseAND(0xFFFF), 16).bitwiseOR(low.bitwiseAND(0xFFFF))
    carry = F.shiftright(mid, 16)
    cross = hi * m0 + F.shiftleft((hi * m1).bitwiseAND(0xFFFF), 16)
    new_hi = (carry + (lo * MUL_HI).bitwiseAND(MASK) + cross).bitwiseAND(MASK)
    return new_hi, new_lo


def jump_shard(hi: Column, lo: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a 64-bit key given as halves.

    Each step jumps to the next shard count at which the key would move; the last jump below `shards` is
    the answer. With one more shard a key either stays or moves into the new one.
    """

    def step(s: Column) -> Column:
        new_hi, new_lo = _next(s.hi, s.lo)
        ahead = F.floor((s.j + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + 1).cast("double")))
        going = s.j < shards
        return F.struct(
            F.when(going, new_hi).otherwise(s.hi).alias("hi"), F.when(going, new_lo).otherwise(s.lo).alias("lo"),
            F.when(going, s.j).otherwise(s.b).alias("b"), F.when(going, ahead).otherwise(s.j).alias("j"),
        )

    zero = F.lit(0).cast("bigint")
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("bigint").alias("b"), zero.alias("j"))
    few = min(FIRST_JUMPS, shards)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, lambda s, _: step(s))
    if shards > few:  # every jump passes one shard at least, so `shards` steps end for any key
        rest = F.sequence(F.lit(few + 1), F.lit(shards))
        state = F.aggregate(F.array(state), start, lambda _, s: F.when(s.j >= shards, s).otherwise(F.aggregate(rest, s, lambda t, __: step(t))))
    return state["b"].cast("int")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """Every row with its shard: id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size is the UTF-8 length plus 8. slot numbers the rows of a shard from 0 without gaps; grown_shard is
    the shard when there is one more. Id and shard count alone decide.

    Rows are numbered inside (shard, chunk of the id's hash) and a chunk starts where the chunks before
    it end, so that no task holds a whole shard however large it is. The offsets are shards x chunks rows.

    A null text is empty (size 8, checksum 0). Rows that repeat an id share a shard and have slots of their
    own; rows without an id are one key. No rows in, no rows out. Other columns are not read.
    """
    hi, lo, chunk = stable_key(F.col(id_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), hi.alias("hi"), lo.alias("lo"),
        F.pmod(chunk, F.lit(chunks)).alias("chunk"),
    ).select(
        "id", "size", "text_crc32", "chunk", jump_shard(F.col("hi"), F.col("lo"), shards).alias("shard"),
        jump_shard(F.col("hi"), F.col("lo"), shards + 1).alias("grown_shard"),
    )
    inside = Window.partitionBy("shard", "chunk").orderBy("id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    only_keys = docs.select(hi.alias("hi"), lo.alias("lo"), F.pmod(chunk, F.lit(chunks)).alias("chunk"))
    counts = only_keys.select(jump_shard(F.col("hi"), F.col("lo"), shards).alias("shard"), "chunk").groupBy("shard", "chunk").count()
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return numbered.join(offsets, ["shard", "chunk"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("at")).cast("bigint").alias("slot"), "grown_shard",
    )
