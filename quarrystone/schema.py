"""Fixed schemas. Nothing in the engine infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = "title string, text string, source string, creation_date string, raw_data map<string,string>, seq long, error string"

NODE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("children_ids", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("context", T.StringType()),
        T.StructField("document_section", T.StringType()),
        T.StructField("chunk_role", T.StringType()),
        T.StructField("entities", T.ArrayType(T.StringType())),
    ]
)

#: What a stored point keeps beside its vectors.
PAYLOAD = ["text_unit_id", "text", "original_text", "document_id", "source", "title", "n_tokens", "level", "parent_id", "children_ids", "context", "document_section", "chunk_role", "entities"]

ENRICHMENT = "context string, document_section string, chunk_role string, entities array<string>"
MANIFEST = "project string, root_url string, created_at string, visited array<string>, saved_pages array<struct<url:string,page_path:string,tree_path:string>>"
