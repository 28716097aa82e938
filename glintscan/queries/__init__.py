"""All registered queries."""

from glintscan.queries import (  # noqa: F401
    dataset_queries,
    file_queries,
    match_queries,
    report_queries,
    text_queries,
)
from glintscan.queries.registry import ORACLES, QUERIES  # noqa: F401
