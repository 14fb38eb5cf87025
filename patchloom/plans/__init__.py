"""Registered queries over the given tables, grouped by topic."""

from patchloom.plans import chunk_queries, flow_queries, io_queries, job_queries, prompt_queries, reply_queries, text_queries, validation_queries
from patchloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
