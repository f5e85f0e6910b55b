"""Scalar functions of probabilistic counting: a linear hash, its bits, and the estimator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash h(v) = (A * v + B) mod Q and of the estimator.
A = 1073741827
B = 17179869209
Q = 4294967291
PHI = 0.77351
TOP_BIT = 30  # reachability bitmaps keep bits 0 to 30


def linear_hash(v: Column) -> Column:
    """(A * v + B) mod Q for v >= 0; v is reduced first, so no long overflows."""
    return (F.lit(A).cast("long") * F.pmod(v.cast("long"), F.lit(Q).cast("long")) + F.lit(B).cast("long")) % F.lit(Q).cast("long")


def bucket_of(h: Column, k: Column) -> Column:
    return h % k


def tail_of(h: Column, k: Column) -> Column:
    return F.floor((h - h % k) / k).cast("long")


def lowest_set(t: Column) -> Column:
    """Position of the lowest set bit; t must not be 0."""
    return F.bit_count(t.bitwiseAND(-t) - 1)


def lowest_unset(bm: Column) -> Column:
    return F.bit_count(F.bitwise_not(bm).bitwiseAND(bm + 1) - 1)


def stream_bit(tail: Column) -> Column:
    """The bit that a tail sets in the distinct count: a zero tail sets bit 0."""
    return F.when(tail == 0, F.lit(1).cast("long")).otherwise(tail.bitwiseAND(-tail))


def reach_bit(tail: Column) -> Column:
    """The bit that a tail sets in the reachability sketch: none for a zero tail, at most the top bit."""
    return F.when(tail == 0, F.lit(0).cast("long")).otherwise(F.least(tail.bitwiseAND(-tail), F.lit(1 << TOP_BIT).cast("long")))


def estimate(k: Column, total: Column) -> Column:
    """floor((k / PHI) * 2 ** (total / k)), total being the sum of lowest unset bits over k buckets."""
    return F.floor(k / F.lit(PHI) * F.pow(F.lit(2.0), total / k)).cast("long")
