"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

FINDINGS = T.ArrayType(
    T.StructType(
        [
            T.StructField("category", T.StringType()),
            T.StructField("count", T.LongType()),
            T.StructField("redacted_examples", T.ArrayType(T.StringType())),
        ]
    )
)
REASONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("vars", T.MapType(T.StringType(), T.StringType())),
        ]
    )
)

FILES = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("first_seen_at", T.LongType()),
        T.StructField("last_seen_at", T.LongType()),
        T.StructField("ignored", T.BooleanType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)

SCANS = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("scanned_at", T.LongType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("risk_score", T.LongType()),
        T.StructField("weak_zip_encryption", T.BooleanType()),
        T.StructField("reasons", REASONS),
        T.StructField("findings", FINDINGS),
        T.StructField("custom_findings", FINDINGS),
        T.StructField("suggestion", T.StringType()),
    ]
)

REMINDERS = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("threshold", T.StringType()),
        T.StructField("due_at", T.LongType()),
        T.StructField("sent_at", T.LongType()),
    ]
)

IGNORED_VALUES = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("value_hash", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)

DEVICES = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("device_name", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("paired_at", T.LongType()),
        T.StructField("expires_at", T.LongType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("last_seen_at", T.LongType()),
    ]
)

FLEET_ALERTS = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("device_name", T.StringType()),
        T.StructField("received_at", T.LongType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("risk_score", T.LongType()),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("last_seen_at", T.LongType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("display_name_key", T.StringType()),
        T.StructField("description_key", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("requires_key", T.BooleanType()),
        T.StructField("key_labels", T.ArrayType(T.StringType())),
        T.StructField("blocked_extensions", T.ArrayType(T.StringType())),
        T.StructField("filename_keywords", T.MapType(T.StringType(), T.LongType())),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("locale_requirement", T.StringType()),
        T.StructField("positive_indicators", T.StringType()),
        T.StructField("negative_indicators", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("filename_regex", T.StringType()),
        T.StructField("field_name_regex", T.StringType()),
        T.StructField("value_regex", T.StringType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("origin", T.StringType()),
    ]
)

ENTITY_SETTINGS = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("entity_category", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("positive", T.ArrayType(T.StringType())),
        T.StructField("negative", T.ArrayType(T.StringType())),
        T.StructField("threshold", T.DoubleType()),
    ]
)

LABELLED_CASES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("target_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("should_detect", T.BooleanType()),
        T.StructField("origin", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("source_license", T.StringType()),
        T.StructField("source_name", T.StringType()),
    ]
)

FILE_CHANGES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("changed_at", T.TimestampType()),
        T.StructField("is_file", T.BooleanType()),
    ]
)
