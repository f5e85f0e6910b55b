"""A bounded bitmap test for long ids, to keep most rows out of a shuffle.

It never misses a listed id; others may pass, and the join that follows is exact.  The
bitmap has at most ``cascade.MAX_BITS`` bits whatever the list's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.cascade import _filter_of, _passes


def maybe_in(value: Column, ids: DataFrame) -> Column:
    """False only if ``value`` isn't among ``ids.key``; null never passes."""
    bits, n_bits = _filter_of(ids, 0, ids.count())
    return F.coalesce(value.isNotNull() & _passes(value, 0, bits.scalar(), n_bits), F.lit(False))
