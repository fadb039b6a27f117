from tracemill.operators.aggregates import (
    count_by_code, count_distinct, distinct_then_count, distribution, latest_by, mean_gap, row_count,
    share_within, six_number_summary,
)
from tracemill.operators.asof import as_of_join
from tracemill.operators.cache import cached
from tracemill.operators.histogram import bucket_histogram, centred_histogram
from tracemill.operators.joins import fits_broadcast, lookup_join
from tracemill.operators.order import stored_order

__all__ = [
    "as_of_join", "bucket_histogram", "cached", "centred_histogram", "count_by_code", "count_distinct", "distinct_then_count",
    "distribution", "fits_broadcast", "latest_by", "lookup_join", "mean_gap", "row_count", "share_within",
    "six_number_summary", "stored_order",
]
