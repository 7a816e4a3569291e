"""Jump consistent hashing of stable keys to shards, in DataFrame functions only."""
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import prefix_sums, unused

#: Multiplier of the 64-bit linear congruential generator that the published method steps with.
LCG = 2862933555777941757


def jump_shard(key: Column, shards: int) -> Column:
    """The shard 0..shards-1 of a long key: no table of shards, and one more shard takes rows only into itself.

    Every jump at least adds one, so `shards` steps are enough; after the last jump a step keeps the state.
    The generator's product is taken in decimal(38), which holds the product of any two of its factors.
    """
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    seed = key.cast("decimal(20,0)")
    seed = F.when(seed < 0, seed + two64).otherwise(seed).cast("decimal(20,0)")
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), seed.alias("k"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(LCG).cast("decimal(19,0)") + F.lit(1)) % two64).cast("decimal(20,0)")
        high = F.floor(k / F.lit(1 << 33).cast("decimal(11,0)")).cast("long")
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double"))).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), j.alias("j"), k.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)["b"].cast("int")


def shard(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """Add shard, slot (gapless from 0 in each shard), grown_shard (with one shard more), size and text_crc32.

    `key` is a long; a null key counts as 0. A null text counts as empty. Equal keys share a shard. Slots follow
    the MD5 of the key, then the key and the text's checksum, so they do not depend on the partitioning; rows
    equal in these take their slots in any order. An empty table gives an empty result. Added names replace
    other columns of the same name.
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    t = F.coalesce(F.col(text), F.lit(""))
    digest, = unused(docs, "digest")
    added = {"size": (F.octet_length(t) + 16).cast("long"), "text_crc32": F.crc32(t.cast("binary")),
             "shard": jump_shard(k, shards), "grown_shard": jump_shard(k, shards + 1), digest: F.md5(k.cast("string"))}
    kept = [F.col(f"`{c}`") for c in docs.columns if c in (key, text) or c not in ("slot", *added)]
    d = docs.select(*kept, *[c.alias(n) for n, c in added.items()])
    return prefix_sums(d, ["shard"], digest, [key, "text_crc32"], F.lit(1).cast("long"), "slot").drop(digest)
