"""Column layouts, value lists and defaults shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed value lists of the data model, in their defined order.
SOURCE_TYPES = [
    "file",
    "directory",
    "codebase",
    "website",
    "sql_database",
    "git_history",
    "api_endpoint",
]
SOURCE_STATUSES = ["pending", "ingesting", "ingested", "failed"]
PAGE_TYPES = ["entity", "concept", "summary", "index", "comparison", "synthesis"]
PHASES = ["initialize", "read_source", "chunk", "embed", "integrate_wiki", "finalize"]
RUN_STATUSES = ["pending", "running", "completed", "failed"]
LINT_TYPES = ["orphan_page", "missing_page", "stale_ref", "coverage_gap", "index_drift"]

# Defaults that decide results.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
TOP_K = 10
VECTOR_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
MAX_COMMITS = 100
UNKNOWN_MODEL_DIMENSION = 1536

INDEX_TITLE = "Index"

STRINGS = T.MapType(T.StringType(), T.StringType())

KBS = (
    "kb_id string, name string, description string, config map<string,string>,"
    " created_at timestamp, updated_at timestamp"
)
SOURCES = (
    "source_id string, kb_id string, source_type string, uri string,"
    " metadata map<string,string>, ingested_at timestamp, chunk_count int, status string"
)
CONTENTS = "source_id string, kb_id string, part int, text string, metadata map<string,string>"
CHUNKS = (
    "chunk_id string, source_id string, kb_id string, part int, chunk_index int,"
    " content string, metadata map<string,string>"
)
VECTORS = (
    "vec_id string, kb_id string, embedding array<float>, document string,"
    " metadata map<string,string>"
)
PAGES = (
    "page_id string, kb_id string, title string, content string, page_type string,"
    " tags array<string>, created_at timestamp, updated_at timestamp"
)
LINKS = "from_page_id string, to_page_id string"
PAGE_SOURCES = "page_id string, source_id string"
RUN_EVENTS = (
    "run_id string, kb_id string, source_id string, seq long, phase string,"
    " status string, ts timestamp, error string"
)
QUERIES = "query_id string, kb_id string, text string"
