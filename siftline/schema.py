"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("_id", T.StringType()), ("doc_id", T.StringType()), ("object_key", T.StringType()), ("bucket", T.StringType()), ("filename", T.StringType()), ("extension", T.StringType()),
            ("mime_type", T.StringType()), ("download_url", T.StringType()), ("owner", T.StringType()), ("size_bytes", T.LongType()), ("uploaded_at", T.TimestampType()), ("chunk_index", T.IntegerType()),
            ("chunk_total", T.IntegerType()), ("chunk_text", T.StringType()), ("embedding", T.ArrayType(T.FloatType())), ("language", T.StringType()), ("tags", T.ArrayType(T.StringType())),
            ("author", T.StringType()), ("title", T.StringType()), ("page_count", T.IntegerType()), ("doc_created_at", T.TimestampType()), ("indexed_at", T.TimestampType()), ("ingestion_status", T.StringType()), ("error_message", T.StringType()),
        ]
    ]
)

EVENT = "struct<Records:array<struct<eventName:string,s3:struct<bucket:struct<name:string>,object:struct<key:string,size:bigint,contentType:string>>>>>"
ENVELOPE = "struct<original_payload:string,error:string,bucket:string,key:string,failed_at:string,retry_count:int,last_retried_at:string,permanently_failed_at:string>"
CHUNKS = "array<struct<text:string,chunk_index:int,start_char:int,end_char:int,total_chunks:int>>"
