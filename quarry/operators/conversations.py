"""Conversation history, question/answer pairs, feedback and golden questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scale import first_per_key


def history(messages: DataFrame) -> DataFrame:
    """Time, conversation, question before answer, id."""
    return messages.orderBy("created_at", "conversation_id", F.when(F.col("role") == "user", 0).otherwise(1), "message_id")


def answered_questions(messages: DataFrame) -> DataFrame:
    """Each assistant message with the first user message of its conversation."""
    asked = messages.filter("role = 'user'").groupBy("conversation_id").agg(
        F.min_by("content", F.struct("created_at", "message_id")).alias("question"))
    answers = messages.filter("role = 'assistant'").select("conversation_id", "message_id", F.col("content").alias("answer"))
    return answers.join(asked, "conversation_id", "left")


def feedback(stored: DataFrame | None, arriving: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest rating per (message, user) on assistant messages, and the rejected rows.

    ``arriving``: message_id, user_id, rating, ts, feedback_id.
    """
    roles = messages.select("message_id", "role")
    joined = arriving.join(roles, "message_id", "left")
    reason = F.when(F.col("role").isNull(), "message not found").when(F.col("role") != "assistant", "only answers can be rated")
    checked = joined.withColumn("reason", reason)
    good = checked.filter("reason is null").select(arriving.columns)
    if stored is not None:
        good = stored.select(arriving.columns).unionByName(good)
    return first_per_key(good, ["message_id", "user_id"], ["ts", "feedback_id"], latest=True), checked.filter("reason is not null").drop("role")


def with_own_rating(messages: DataFrame, ratings: DataFrame, user_id) -> DataFrame:
    mine = ratings.filter(F.col("user_id") == user_id).select("message_id", F.col("rating").alias("my_rating"))
    return messages.join(mine, "message_id", "left")


def golden_questions(messages: DataFrame, traces: DataFrame, picked: DataFrame) -> DataFrame:
    """Snapshot of picked answers: question, reference answer and context texts.

    ``traces``: message_id, hits array<struct<index, content>>.
    """
    pairs = answered_questions(messages).join(picked, "message_id")
    texts = F.transform(F.array_sort("hits"), lambda h: h["content"])
    return pairs.join(traces, "message_id").select(
        "message_id", "question", F.col("answer").alias("reference_answer"), texts.alias("reference_contexts"))


def active_golden(questions: DataFrame, notebook_id) -> DataFrame:
    return questions.filter((F.col("notebook_id") == notebook_id) & F.col("active")).orderBy("created_at", "question_id")
