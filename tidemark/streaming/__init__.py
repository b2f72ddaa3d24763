"""Structured Streaming ingestion."""
from .watch import (merge_into_partitions, stream_merge, stream_merge_partitioned,  # noqa: F401
                    watch_landing)
