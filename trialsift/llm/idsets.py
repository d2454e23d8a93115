"""A set of ids as a bitmap, to drop rows before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift.llm.common import fresh, quoted
from trialsift.session import settle_table

PER_ID = 16  # bits for each wanted id
LEAST, MOST = 1 << 20, 1 << 30  # 128 megabytes are broadcast at most; only beyond 2^26 ids do more rows pass


def marked(df: DataFrame, key: Column, ids: DataFrame, name: str) -> DataFrame:
    """Add the boolean ``name``: false only where ``key`` is not among ``ids`` (one column).

    The bitmap has ``PER_ID`` bits for each id, counted before, and at most ``MOST``; so it is broadcast.
    Ids are whole numbers.  A NULL key is in no set.
    """
    ids = settle_table(ids)
    bits_, held = LEAST, PER_ID * ids.count()
    while bits_ < held and bits_ < MOST:
        bits_ *= 2
    bucket, bitmap, place = fresh(df, "bucket", "bitmap", "place")
    spot = F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(bits_))
    bits = ids.select(spot.alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bitmap)
    )
    own = F.when(key.isNotNull(), F.pmod(F.xxhash64(key.cast("long")), F.lit(bits_)))
    placed = df.withColumn(place, own)
    joined = placed.join(F.broadcast(bits), F.bitmap_bucket_number(quoted(place)) == quoted(bucket), "left")
    at = F.bitmap_bit_position(quoted(place)).cast("int")
    byte = F.conv(F.hex(F.substr(quoted(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int"))
    return joined.withColumn(name, F.coalesce(hit != 0, F.lit(False))).drop(bucket, bitmap, place)
