"""Conversations and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.retrieval import manual_title
from quarry.functions.text import strip, txt


def conversation_history(conversations: DataFrame, messages: DataFrame, user: str | None = None) -> DataFrame:
    """Conversations, newest first, each with its messages, oldest first; null citations are empty. A conversation's
    messages are one row by contract; use messages_in_order where that is too much."""
    c = conversations if user is None else conversations.where(F.col("user_id") == user)
    m = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content", F.coalesce("citations", F.lit("[]")).alias("citations"), "model_used"))).alias("messages"))
    out = c.join(m, c["id"] == m["conversation_id"], "left").drop("conversation_id")
    return out.withColumn("messages", F.coalesce("messages", F.expr("cast(array() as array<struct<created_at:timestamp,id:string,role:string,content:string,citations:string,model_used:string>>)"))).orderBy(F.desc("updated_at"), "id")


def messages_in_order(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """A row per message with its conversation's columns; order by updated_at desc, conversation_id, created_at, id."""
    c = conversations.select(F.col("id").alias("conversation_id"), "user_id", "title", "updated_at")
    return messages.withColumn("citations", F.coalesce("citations", F.lit("[]"))).join(c, "conversation_id")


def owned_by(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """requests (conversation_id, user_id) with outcome: not_found, forbidden or ok."""
    c = conversations.select(F.col("id").alias("_c"), F.col("user_id").alias("_owner"))
    j = requests.join(c, F.col("conversation_id") == F.col("_c"), "left")
    return j.withColumn("outcome", F.when(F.col("_c").isNull(), "not_found").when(~F.col("_owner").eqNullSafe(F.col("user_id")), "forbidden").otherwise("ok")).drop("_c", "_owner")


def conversation_buckets(conversations: DataFrame, as_of: Column) -> DataFrame:
    """Adds bucket: today, yesterday, last7Days (from six days back) or older; newest first."""
    day, today = F.to_date("updated_at"), F.to_date(as_of)
    b = F.when(day >= today, "today").when(day >= F.date_sub(today, 1), "yesterday").when(day >= F.date_sub(today, 6), "last7Days").otherwise("older")
    return conversations.withColumn("bucket", b).orderBy(F.desc("updated_at"), "id")


def delete_conversations(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations among ids."""
    gone = ids.select("id").distinct()
    return conversations.join(gone, "id", "left_anti"), messages.join(gone.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")


def append_exchange(conversations: DataFrame, messages: DataFrame, answers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """answers: (conversation_id, exchange_id, question, answer, citations, model_used): adds a user and an assistant row
    each, and touches the conversations. Answers to unknown conversations are left out."""
    a = answers.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    row = lambda part, role, content, cites, model: a.select(F.concat("exchange_id", F.lit(part)).alias("id"), "conversation_id", F.lit(role).alias("role"), F.col(content).alias("content"), cites.alias("citations"), model.alias("model_used"), now.cast("timestamp").alias("created_at"))
    none = F.lit(None).cast("string")
    new = row("_1", "USER", "question", none, none).unionByName(row("_2", "ASSISTANT", "answer", F.col("citations"), F.col("model_used")))
    touched = a.select(F.col("conversation_id").alias("_c")).distinct()
    c = conversations.join(touched, F.col("id") == F.col("_c"), "left").withColumn("updated_at", F.when(F.col("_c").isNotNull(), now.cast("timestamp")).otherwise(F.col("updated_at"))).drop("_c")
    return c, messages.unionByName(new, allowMissingColumns=True)


def rename_conversation(conversations: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """requests: (conversation_id, user_id, title). (conversations, outcomes): blank titles and other people's conversations
    are refused, titles are cut at 100 characters."""
    r = owned_by(requests, conversations)
    r = r.withColumn("outcome", F.when(strip(txt("title")) == "", "blank").otherwise(F.col("outcome")))
    ok = r.where("outcome = 'ok'").groupBy(F.col("conversation_id").alias("_c")).agg(F.max("title").alias("_t"))
    c = conversations.join(ok, F.col("id") == F.col("_c"), "left")
    hit = F.col("_c").isNotNull()
    c = c.withColumns({"title": F.when(hit, manual_title(F.col("_t"))).otherwise(F.col("title")), "updated_at": F.when(hit, now.cast("timestamp")).otherwise(F.col("updated_at"))}).drop("_c", "_t")
    return c, r


def question_log_status(citations: Column) -> Column:
    """refused where an answer cites nothing, else answered; citations: JSON array."""
    n = F.coalesce(F.json_array_length(citations), F.lit(0))
    return F.when(n == 0, "refused").otherwise("answered")
