"""Structured Streaming forms of the row-local checks, links and repeats."""

from sedgetable.streaming.jobs import flag_repeats, link_arrivals, run_available, stream_cell_findings

__all__ = ["flag_repeats", "link_arrivals", "run_available", "stream_cell_findings"]
