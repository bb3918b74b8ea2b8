"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType.fromDDL("doc_id bigint, source string, file_name string, file_path string, file_type string, file_size bigint, loaded_at timestamp, title string, is_markdown boolean, content string")
CHUNKS = T.StructType.fromDDL("topic_id string, chunk_id string, doc_id bigint, chunk_index int, content string, chunk_size int, heading_path array<string>, heading_level int, section_title string, loc_lines_from int, loc_lines_to int, embedding array<float>")
HITS = T.StructType.fromDDL("query_id bigint, sub_idx int, rank int, chunk_id string, score double, vector_score double, keyword_score double, strategy string, explanation string")
TOPICS = T.StructType.fromDDL("id string, name string, description string, created_at timestamp, updated_at timestamp, document_count bigint, source string")
TOPIC_DOCUMENTS = T.StructType.fromDDL("id string, topic_id string, name string, file_path string, file_type string, added_at timestamp, chunk_count bigint")
STORE_METADATA = T.StructType.fromDDL("topic_id string, document_count bigint, chunk_count bigint, embedding_model string, created_at timestamp, updated_at timestamp")
PLAN = T.StructType.fromDDL("original_query string, complexity string, sub_queries array<struct<query:string,reasoning:string,top_k:int,priority:string>>, strategy string, explanation string")
