"""Prompt assembly and conversation history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import estimated_tokens


def blended(ranked: DataFrame, blend: float = 0.48) -> DataFrame:
    """``ranked`` (question_id, rank, lex) with ``place``: a blend of scaled lexical score and the order so far."""
    w = Window.partitionBy("question_id")
    n, low, high = F.count(F.lit(1)).over(w), F.min("lex").over(w), F.max("lex").over(w)
    scaled = F.when(high > low, (F.col("lex") - low) / (high - low)).otherwise(1.0)
    order = F.when(n > 1, (n - F.col("rank")) / (n - 1)).otherwise(1.0)
    mixed = ranked.withColumn("blend", scaled * blend + order * (1 - blend))
    return mixed.withColumn("place", F.row_number().over(w.orderBy(F.round("blend", 9).desc(), "rank")))


def within_budget(rows: DataFrame, tokens: str, budget: int, order: str = "place") -> DataFrame:
    """The first excerpt and all that follow until the running sum of tokens passes the budget."""
    w = Window.partitionBy("question_id").orderBy(order)
    total = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(w) == 1
    return rows.withColumn("total_tokens", total).withColumn("__f", first).where(F.col("__f") | (F.col("total_tokens") <= budget)).drop("__f")


def prompts(excerpts: DataFrame, questions: DataFrame, system: str, history: DataFrame | None = None) -> DataFrame:
    """question_id, prompt: system text, excerpts in order, history and question."""
    body = excerpts.groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "excerpt"))), lambda x: x["excerpt"]), "\n---\n").alias("body")
    )
    out = questions.select("question_id", "question").join(body, "question_id", "left")
    past = F.lit("")
    if history is not None:
        turns = history.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("h"))
        out = out.join(turns, "question_id", "left")
        said = F.transform("h", lambda x: F.concat(x["role"], F.lit(": "), x["content"]))
        past = F.coalesce(F.array_join(said, "\n"), F.lit(""))
    return out.select(
        "question_id",
        F.concat_ws("\n\n", F.lit(system), F.coalesce("body", F.lit("")), past, F.concat(F.lit("Question: "), F.col("question"))).alias("prompt"),
    )


def history_turns(questions: DataFrame) -> DataFrame:
    """question_id, turn, role, content: the turns of the histories; only those of user and assistant with content."""
    return (
        questions.select("question_id", F.posexplode("history").alias("turn", "h"))
        .select("question_id", "turn", "h.role", "h.content")
        .where("role in ('user', 'assistant') and content is not null")
    )


def history_within(turns: DataFrame, budget: int = 1500) -> DataFrame:
    """The newest turns whose tokens together stay within the budget."""
    tokens = turns.withColumn("tokens", estimated_tokens(F.col("content")))
    w = Window.partitionBy("question_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("total_tokens", F.sum("tokens").over(w)).where(F.col("total_tokens") <= budget)


def thread_depth(turns: DataFrame) -> DataFrame:
    """``turns`` with ``depth``: how many user turns there are so far."""
    w = Window.partitionBy("question_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("depth", F.sum((F.col("role") == "user").cast("int")).over(w))


def thread_history(messages: DataFrame) -> DataFrame:
    """thread, seq, role, content: what of each thread may be sent along as its history.

    ``messages``: thread, seq, role, content, answer, status. Only finished messages (no status) of user and assistant; an
    assistant's answer, where there is one, goes before its content. Messages without either are left out.
    """
    said = F.when(F.col("role") == "assistant", F.coalesce("answer", "content")).otherwise(F.col("content"))
    kept = messages.where("status is null and role in ('user', 'assistant')").select("thread", "seq", "role", said.alias("content"))
    return kept.where("content is not null")
