"""A Bloom filter of a key set as a small table, to keep rows that cannot match out of a join's shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of one row of the table; what the bitmap aggregate makes.
SLOT = 8 * 4096
#: 32 MB: the most that is broadcast. A set too large for it fills the filter, which then keeps fewer rows out.
MOST_BITS = 1 << 28
BITS_PER_KEY = 16


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def filter_bits(keys: DataFrame, key: str) -> int:
    """A power of two that gives each distinct key ``BITS_PER_KEY`` bits, within the bound."""
    distinct = keys.agg(F.approx_count_distinct(key)).first()[0]
    return min(MOST_BITS, max(SLOT, 1 << (distinct * BITS_PER_KEY - 1).bit_length() if distinct else SLOT))


def key_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(_slot, _bits): one bit set for each key, reduced by task before the shuffle."""
    place = _place(F.col(key), bits)
    set_bits = keys.where(F.col(key).isNotNull()).select(F.floor(place / SLOT).alias("_slot"), (place % SLOT).alias("_bit"))
    return set_bits.groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def by_filter(facts: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``facts`` whose key may be among ``keys``, and those whose key is not.

    With 16 bits a key one in 16 rows without a match, at most, passes. Facts are not shuffled. A null key matches nothing.
    """
    if facts.schema[key].dataType != keys.schema[key].dataType:
        raise ValueError(f"{key} has different types on both sides")
    bits = filter_bits(keys, key)
    place = _place(F.col(key), bits)
    probed = facts.withColumn("_slot", F.floor(place / SLOT)).join(F.broadcast(key_filter(keys, key, bits)), "_slot", "left")
    bit = place % SLOT
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return probed.where(hit).select(*facts.columns), probed.where(~hit).select(*facts.columns)
