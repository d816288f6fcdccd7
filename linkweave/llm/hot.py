"""Joins with a table of unique keys, where few keys may hold most rows; and a sieve before joins that few rows pass.

A key with more than 1/``PARTS`` of all rows is hot; by this measure there are fewer than ``PARTS`` of them, whatever the
size of the table. Their rows of the unique side are broadcast, so that the many rows of a hot key stay where they are;
all others meet by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 256
#: Bits of a sieve, in powers of two: at most 2^27 of them, in 2^21 rows of two longs, are broadcast.
LEAST_BITS, MOST_BITS = 16, 27


def join_unique(rows: DataFrame, unique: DataFrame, key: str, count: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``unique``: settled, one row for each key, ``count`` its rows in ``rows`` (dropped).

    Rows whose key is null, or isn't in ``unique``, go in an inner join, and stay with nulls in a left one.
    """
    total = unique.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in unique.filter(F.col(count) * PARTS > total).select(key).collect()] if total > PARTS else []  # fewer than PARTS
    plain = unique.drop(count)
    if not hot:
        return rows.join(plain, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.filter(~is_hot).join(plain.filter(~is_hot), key, how).unionByName(rows.filter(is_hot).join(F.broadcast(plain.filter(is_hot)), key))


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``may``: whether their ``key`` may be among those of ``wanted`` (settled). True for all that are.

    Keys are known by one bit of a hash, some eight bits for each wanted key up to a bound, beyond which more rows pass.
    What passes is joined exactly afterwards: a sieve only holds rows back from a shuffle.
    """
    n_bits = min(MOST_BITS, max(LEAST_BITS, (8 * wanted.count()).bit_length()))
    place = F.xxhash64(key).bitwiseAND(F.lit((1 << n_bits) - 1))
    words = wanted.select(place.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at & 63 as int)))").alias("_bits"))
    met = rows.withColumn("_at", place).join(F.broadcast(words), F.shiftright("_at", 6) == F.col("_word"), "left")
    return met.withColumn("may", F.expr("coalesce(shiftright(_bits, cast(_at & 63 as int)) & 1, 0) = 1")).select(*rows.columns, "may")


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``key`` may be among those of ``wanted``: all that are, and few others."""
    return sieved(rows, key, wanted).filter("may").drop("may")
