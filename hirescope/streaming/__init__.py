"""Incremental upkeep of the latest-posting table from the append-only landing folder."""

from hirescope.streaming.landing import (
    latest_postings_stream,
    latest_state,
    merge_latest,
    read_latest,
    silver_from_latest,
)

__all__ = ["latest_postings_stream", "latest_state", "merge_latest", "read_latest", "silver_from_latest"]
