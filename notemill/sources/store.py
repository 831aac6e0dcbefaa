"""Tables that results go to: documents, entities, predictions, audit rows, the code dimension. Each is a DataFrame to be written where the caller likes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "import") -> DataFrame:
    """key, content, content_hash, source, is_processed."""
    return docs.select(F.col(key).alias("document_id"), F.col(text).alias("content"), F.sha2(F.col(text).cast("binary"), 256).alias("content_hash"), F.lit(source).alias("source"), F.lit(False).alias("is_processed"))


def entity_rows(entities: DataFrame, key: str = "doc_id", model: str = "rules-1") -> DataFrame:
    """One row an entity: document_id, entity_type, text, start_char, end_char, confidence, model_version."""
    return entities.select(F.col(key).alias("document_id"), F.col("type").alias("entity_type"), F.col("match").alias("text"), F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("confidence"), F.lit(model).alias("model_version"))


def predictions(df: DataFrame, result: list[str], kind: str, model: str, key: str = "doc_id", confidence: Column | None = None) -> DataFrame:
    """document_id, prediction_type, model_name, result (JSON), confidence."""
    return df.select(F.col(key).alias("document_id"), F.lit(kind).alias("prediction_type"), F.lit(model).alias("model_name"), F.to_json(F.struct(*result)).alias("result"), (confidence if confidence is not None else F.lit(None).cast("double")).alias("confidence"))


def new_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key the known table lacks: an upsert that only inserts."""
    return rows.join(known.select(key), key, "left_anti")


def unprocessed(docs: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents without a row in the table of processed ids; nothing is updated in place."""
    return new_only(docs, done, key)


def progress(total: Column, done: Column) -> Column:
    return F.when(total > 0, F.round(done / total, 4)).otherwise(0.0)


def server_sent(df: DataFrame, event: str) -> DataFrame:
    """frame: an event-stream frame for each row."""
    return df.select(F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("frame"))


def exposition(counts: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """line: a counter's samples as text."""
    return counts.select(F.format_string(f'{name}{{{label}="%s"}} %s', F.col(label), F.col(value).cast("string")).alias("line"))


def audit_rows(df: DataFrame, action: str, model: str, key: str = "doc_id", text: str = "text", status: Column | None = None) -> DataFrame:
    """action, resource_type, resource_id, document_hash (never the content), model_version, status_code: rows to append."""
    status = status if status is not None else F.lit(200)
    return df.select(F.lit(action).alias("action"), F.lit("document").alias("resource_type"), F.col(key).cast("string").alias("resource_id"), F.sha2(F.col(text).cast("binary"), 256).alias("document_hash"), F.lit(model).alias("model_version"), status.alias("status_code"))
