"""Conversations and messages as append-only Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONVERSATIONS = "id string, title string, created_at timestamp"
MESSAGES = "id string, conversation_id string, seq long, role string, content string, structured_response string, created_at timestamp"


class SessionStore:
    """Appends batches of conversations and messages below one path, and reads them back in order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add_conversations(self, titles: DataFrame) -> None:
        """titles(id, title); a null id gets a new one, a null title the default."""
        rows = titles.select(
            F.coalesce("id", F.expr("uuid()")).alias("id"), F.coalesce("title", F.lit("New session")).alias("title"), F.current_timestamp().alias("created_at")
        )
        rows.write.mode("append").parquet(f"{self.path}/conversations")

    def add_messages(self, messages: DataFrame) -> None:
        """messages(conversation_id, seq, role, content) and, if there, structured_response as text; seq orders a conversation."""
        answer = F.col("structured_response") if "structured_response" in messages.columns else F.lit(None)
        rows = messages.select(
            F.expr("uuid()").alias("id"), "conversation_id", F.col("seq").cast("long"), "role", "content", answer.cast("string").alias("structured_response"),
            F.current_timestamp().alias("created_at"),
        )
        rows.write.mode("append").parquet(f"{self.path}/messages")

    def conversations(self) -> DataFrame:
        return self.spark.read.schema(CONVERSATIONS).parquet(f"{self.path}/conversations").orderBy(F.desc("created_at"), "id")

    def messages(self, conversation_id: str) -> DataFrame:
        rows = self.spark.read.schema(MESSAGES).parquet(f"{self.path}/messages").where(F.col("conversation_id") == conversation_id)
        return rows.withColumn("structured", F.expr("try_parse_json(structured_response)")).orderBy("seq", "created_at")


def overview(turns: DataFrame) -> DataFrame:
    """One row per conversation: messages, user messages, title (first 26 characters of the first user message)."""
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.substring(first["text"], 1, 26).alias("title")
    )
