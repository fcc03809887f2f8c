"""A Bloom filter as a column: what isn't in a set of keys is dropped before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at least and at most (8 MB), and bits for each key.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 10, 1 << 26, 16


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: a power of two, never more than MOST_BITS, however many keys there are."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(1, keys) - 1).bit_length()))


def _places(h: Column, bits: int) -> list[Column]:
    """Three places of a hash in a filter."""
    return [F.pmod(x, F.lit(bits)) for x in (h, F.shiftrightunsigned(h, 21), F.xxhash64(h))]


def _shifted(word: Column, by: Column) -> Column:
    return F.call_function("shiftright", word, by)


def may_hold(keys: DataFrame, key: str, bits: int) -> Callable[[Column], Column]:
    """A test of 64-bit hashes against those of ``keys``: false means that a hash isn't there; true is wrong for a few in a thousand, more if the filter is too small.

    The words of the filter are made by grouping, so no more than ``bits`` / 64 rows meet; they are one array of bounded size, which goes
    with the tasks as a scalar subquery. Null hashes are not there; no keys hold nothing.
    """
    places = F.explode(F.array(*_places(F.col(key), bits))).alias("place")
    words = keys.where(F.col(key).isNotNull()).select(places).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("set"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    array = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0)).alias("set")))), lambda x: x["set"]).alias("words")).scalar()

    def test(h: Column) -> Column:
        out = h.isNotNull()
        for p in _places(h, bits):
            out = out & (_shifted(F.get(array, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    return test
