"""Source tables: declared schemas, readers, test-table bindings and sinks."""

from hirescope.sources.clustered import read_clustered, write_clustered
from hirescope.sources.readers import (
    newest_partition_date,
    read_descriptions_raw,
    read_keyword_snapshots,
    read_noise_terms,
    read_postings_raw,
    read_source,
)
from hirescope.sources.schemas import (
    DESCRIPTIONS_RAW,
    KEYWORD_SNAPSHOTS,
    NOISE_TABLE,
    POSTINGS_RAW,
    conform,
)

__all__ = [
    "DESCRIPTIONS_RAW",
    "KEYWORD_SNAPSHOTS",
    "NOISE_TABLE",
    "POSTINGS_RAW",
    "conform",
    "newest_partition_date",
    "read_clustered",
    "read_descriptions_raw",
    "read_keyword_snapshots",
    "read_noise_terms",
    "read_postings_raw",
    "read_source",
    "write_clustered",
]
