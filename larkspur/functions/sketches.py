"""Cardinality sketches: PFADD, PFCOUNT and PFMERGE as mergeable binary columns with 2^14 slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS_LOG2 = 14


def pf_add(element: Column) -> Column:
    """PFADD as an aggregate: the sketch of a group's elements."""
    return F.hll_sketch_agg(element.cast("string"), F.lit(SLOTS_LOG2))


def pf_merge(sketch: Column) -> Column:
    """PFMERGE as an aggregate: the union of sketches."""
    return F.hll_union_agg(sketch)


def pf_count(sketch: Column) -> Column:
    """PFCOUNT: the estimate, within about one per cent."""
    return F.hll_sketch_estimate(sketch)
