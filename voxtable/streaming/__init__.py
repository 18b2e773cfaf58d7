"""Cleaning and features on streams.

The cleaning and feature operators keep no state, so the batch transforms run unchanged on
a streaming table; this module only adds the reader and the checkpointed writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxtable.config import CommentConfig, TicketConfig
from voxtable.operators.cleaning import clean_comments, clean_tickets
from voxtable.operators.features import comment_features, ticket_features


def read_parquet_stream(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def comment_stream(source: DataFrame, cfg: CommentConfig | None = None, is_train: bool = False) -> DataFrame:
    cfg = cfg or CommentConfig()
    return comment_features(clean_comments(source, cfg, is_train), cfg)


def ticket_stream(source: DataFrame, cfg: TicketConfig | None = None) -> DataFrame:
    cfg = cfg or TicketConfig()
    return ticket_features(clean_tickets(source, cfg), cfg)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append to files. Processes what is there, then stops.

    ``checkpoint`` is a folder that stays with ``path``: every restart has to name the same one,
    or the sink takes new batches for ones it has already written.
    """
    if not checkpoint:
        raise ValueError("a checkpoint folder is required: without it a restart loses rows")
    writer = df.writeStream.format(fmt).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(path)
