"""The engine's tables as types, and additive evolution of what was stored earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "urls": "url string, status string, discovered_at timestamp, last_attempt_at timestamp, http_status int, content_type string, file_size bigint, sha256 string, local_path string, error string, etag string, last_modified string",
    "documents": "doc_id bigint, url string, final_url string, title string, content_type string, file_size bigint, sha256 string, local_path string, fetched_at timestamp, relevance_score double, topic_similarity double, entity_density double, url_penalty double",
    "matches": "doc_id bigint, method string, pattern string, score double, snippet string, created_at timestamp",
    "fts_docs": "doc_id bigint, url string, title string, content string",
    "doc_tables": "doc_id bigint, page_no int, table_index int, format string, data array<array<string>>, bbox array<double>, created_at timestamp",
    "doc_entities": "doc_id bigint, label string, canonical string, display string, count bigint, variants array<string>, page_nos array<int>, created_at timestamp",
    "doc_embeddings": "doc_id bigint, model_name string, chunk_index int, start int, end int, vector array<float>, norm double, created_at timestamp",
    "kv": "key string, value string, updated_at timestamp",
    "doc_page_flags": "doc_id bigint, page_no int, flag string, score double, details struct<text_score:double,black_area_ratio:double,big_black_rects:int,dark_pixel_ratio:double,pixel_check_used:boolean>, created_at timestamp",
    "doc_reviews": "doc_id bigint, status string, updated_at timestamp",
    "feedback_centroids": "label string, model_name string, vector array<float>, norm double, count bigint, updated_at timestamp",
}
#: What tells rows of a table apart; nothing enforces it but the upserts.
KEYS = {
    "urls": ("url",),
    "documents": ("sha256",),
    "doc_entities": ("doc_id", "label", "canonical"),
    "doc_embeddings": ("doc_id", "model_name", "chunk_index"),
    "kv": ("key",),
    "doc_reviews": ("doc_id",),
    "feedback_centroids": ("label", "model_name"),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's columns in order: missing ones are null, types are cast, columns
    that the table does not know are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])
