"""A bounded filter of keys: it only saves shuffling rows that cannot match, and lets every row pass that can."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the smallest and the largest filter (16 MB), and hash slots that a bitmap of Spark holds.
LEAST, MOST, BITMAP = 1 << 20, 1 << 27, 1 << 15


def _slot(keys: tuple[str, ...], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def sieve_of(df: DataFrame, *keys: str) -> np.ndarray:
    """Which hash slots the keys of ``df`` (a written table) take, eight to a byte, the first lowest: about sixteen slots
    for a key, but no more than ``MOST``, where ever more rows pass that need not."""
    bits = min(MOST, max(LEAST, 1 << (16 * df.count()).bit_length()))
    at = (_slot(keys, bits) + 1).alias("at")  # bitmaps count from 1
    maps = df.select(at).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")))
    sieve = np.zeros(bits // 8, np.uint8)
    for bucket, held in maps.collect():
        first = (bucket - 1) * BITMAP // 8
        sieve[first : first + len(held)] = np.frombuffer(held, np.uint8)
    return sieve


def sifted(df: DataFrame, sieve: np.ndarray, *keys: str, wanted: bool = True, then=None, schema=None) -> DataFrame:
    """The rows whose keys pass (or, unless ``wanted``, do not), as they are or as ``then`` makes them in the same worker."""
    shared = df.sparkSession.sparkContext.broadcast(sieve)

    def passed(batches):
        for batch in batches:
            slot = batch.column(batch.num_columns - 1).to_numpy()
            hit = (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
            yield batch.filter(pa.array(hit if wanted else ~hit)).select(range(batch.num_columns - 1))

    def run(batches):
        yield from then(passed(batches)) if then else passed(batches)

    return df.withColumn("slot", _slot(keys, 8 * len(sieve))).mapInArrow(run, schema or df.schema)
