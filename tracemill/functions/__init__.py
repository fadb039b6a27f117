from tracemill.functions.columns import (
    bucket_of, capacity, centred_bin, elapsed_seconds, joined_ids, percent, whole_days,
)

__all__ = ["bucket_of", "capacity", "centred_bin", "elapsed_seconds", "joined_ids", "percent", "whole_days"]
