"""Shared helpers: key bitmaps, worker caches, and the library's written tables and salted joins."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.skew import materialise as materialise
from quarry.functions.skew import salted_join as salted_join
from quarry.functions.skew import text_batches as text_batches


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """An object that lives as long as the Python worker process, across its tasks.

    Task code travels by value, so its own module globals are new in every task; the cache
    therefore hangs on a module entry of the process. ``name`` is "group_what": a worker
    keeps one group at a time, so a job's stages do not add up their tables.
    """
    holder = sys.modules.setdefault("_quarry_worker_cache", types.ModuleType("_quarry_worker_cache"))
    group = name.partition("_")[0] + "_"
    for other in [n for n in vars(holder) if not n.startswith(("__", group))]:
        delattr(holder, other)
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def key_bitmap(keys: DataFrame, key: str, bits: int = 1 << 26) -> DataFrame:
    """(bucket, bitmap): a set of hashed keys in at most ``bits`` bits (8 MB), for ``maybe_in``."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return (keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bitmap")))


def maybe_in(df: DataFrame, key: str, bitmap: DataFrame, bits: int = 1 << 26, invert: bool = False) -> DataFrame:
    """Rows whose key is in the bitmap's set, and some others: thins rows out before a join.

    ``invert`` gives the rest instead: rows whose key is certainly not in the set.

    The bitmap is broadcast; its size is bounded by ``bits``. As the set outgrows it, more
    other rows stay, and the join that follows still decides.
    """
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    spot = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substr("_bitmap", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = byte.bitwiseAND(F.pow(F.lit(2), spot % 8).cast("int")) != 0
    keep = F.coalesce(~found, F.lit(True)) if invert else found
    named = bitmap.withColumnRenamed("_bucket", "_bitmap_bucket")
    return (df.withColumn("_bitmap_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(named), "_bitmap_bucket", "left")
            .where(keep).drop("_bitmap_bucket", "_bitmap"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
