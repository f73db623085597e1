"""A semi-join's first step: a map of bounded size that tells which rows may have a partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# bits of the map for each hash, and bits at most (32 MB)
BITS_EACH = 16
BITS_MOST = 1 << 28
_PAGE_BITS = 1 << 15


def rows_in_map(
    df: DataFrame, key: Column, hashes: DataFrame, value: str, bits_each: int = BITS_EACH, always: Column | None = None,
    count: int | None = None,
) -> DataFrame:
    """Rows whose 64-bit hash ``key`` may be in the column ``value`` of ``hashes``, and those where ``always`` holds.

    Other rows with a null key are left out. Every hash sets the bit of its remainder in a map that is sent to all tasks. The map grows
    with the number of hashes (``count``, if known) up to a fixed size; beyond it more rows pass by chance, and none with a partner
    is lost. The columns of ``df`` stay as they are.
    """
    bits = max(_PAGE_BITS, min(BITS_MOST, 1 << ((hashes.count() if count is None else count) * bits_each).bit_length()))

    def place(of: Column) -> Column:
        return F.pmod(of.cast("bigint"), F.lit(bits).cast("bigint"))

    pages = hashes.select(place(F.col(value)).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_page"))
    pages = pages.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_marks"))
    rows = df.withColumn("_place", place(key)).withColumn("_page", F.bitmap_bucket_number("_place"))
    # bits / 8 bytes in all
    rows = rows.join(F.broadcast(pages), "_page", "inner" if always is None else "left")
    octet = F.expr("substring(_marks, int(bitmap_bit_position(_place) div 8) + 1, 1)")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.bitmap_bit_position("_place") % 8).cast("int") + 1)
    marked = F.conv(F.hex(octet), 16, 10).cast("int").bitwiseAND(bit) > 0
    if always is not None:
        marked = F.coalesce(marked, F.lit(False)) | always
    return rows.where(marked).select(*[F.col(f"`{c}`") for c in df.columns])
