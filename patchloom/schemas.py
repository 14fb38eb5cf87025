"""Explicit schemas of the tables that cross stage boundaries."""

from __future__ import annotations

CHUNK = (
    "chunk_id STRING, type STRING, name STRING, start_line INT, end_line INT, "
    "code STRING, metadata MAP<STRING, STRING>"
)
CHUNK_ENVELOPE = (
    f"file_name STRING, language STRING, total_chunks BIGINT, part INT, chunks ARRAY<STRUCT<{CHUNK}>>"
)
PROMPT = (
    "prompt_id BIGINT, is_batch BOOLEAN, chunk_ids ARRAY<STRING>, "
    f"chunks ARRAY<STRUCT<{CHUNK}>>, prompt STRING"
)
PROMPT_ENVELOPE = (
    "file_name STRING, language STRING, total_prompts BIGINT, part INT, "
    f"generated_at TIMESTAMP, prompts ARRAY<STRUCT<{PROMPT}>>"
)
EXAMPLE = (
    "id STRING, language STRING, chunk_type STRING, description STRING, "
    "before STRING, after STRING, notes STRING"
)
EXAMPLE_FILE = f"examples ARRAY<STRUCT<{EXAMPLE}>>"
CHECK_MAP = "MAP<STRING, STRUCT<passed: BOOLEAN, message: STRING>>"
FUNCTION_DETAIL = (
    "STRUCT<total_tests: BIGINT, passed_tests: BIGINT, pass_rate: DOUBLE, "
    "function_results: MAP<STRING, STRUCT<total: BIGINT, passed: BIGINT, pass_rate: DOUBLE, "
    "failures: ARRAY<STRING>>>, "
    "property_failures: ARRAY<STRUCT<function: STRING, property: STRING, message: STRING>>>"
)
REPORT = (
    f"timestamp STRING, file STRING, passed BOOLEAN, severity STRING, pass_rate DOUBLE, "
    f"checks MAP<STRING, STRING>, functional_detail {FUNCTION_DETAIL}"
)
EVENT_LINE = "job_id BIGINT, ts TIMESTAMP, line STRING"
