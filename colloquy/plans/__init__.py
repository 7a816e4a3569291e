"""Registered queries, grouped by area. Importing this package fills the registry."""
from colloquy.plans import (  # noqa: F401
    text_queries, floor_queries, sampling_queries, scoring_queries, call_queries, thread_queries, quality_queries, stream_queries,
)
