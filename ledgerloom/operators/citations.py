"""Numbered context, conversation history and checked citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import bind
from ledgerloom.functions.core import floor_div

# How a marker looks, and how one role is named for the model.
MARKER = r"\[(\d+)\]"
MODEL_ROLES = {"assistant": "model"}


def _pages() -> Column:
    first, last = F.col("page_start"), F.coalesce("page_end", "page_start")
    return F.when(first == last, F.concat(F.lit("p. "), first)).when(
        first.isNotNull(), F.concat(F.lit("pp. "), first, F.lit("–"), last)
    )


def context_block() -> Column:
    """``[n] (Company FY2025, MD&A, pp. 41–43): text``; missing parts are left out."""
    who = F.nullif(F.concat_ws(" ", "company", "fiscal_period"), F.lit(""))
    label = F.concat_ws(", ", who, "section", _pages())
    head = F.concat(F.lit("["), F.col("n"), F.lit("]"))
    return F.concat(
        F.concat_ws(" ", head, F.when(label != "", F.concat(F.lit("("), label, F.lit(")")))), F.lit(": "), F.col("text")
    )


def number_hits(hits: DataFrame) -> DataFrame:
    """Hits with their block number ``n`` (1 for the best) per question."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "id")
    return hits.withColumn("n", F.row_number().over(order))


def build_context(hits: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One context text per question, blocks in order. Hits per question are bounded by k."""
    blocks = number_hits(hits).select("qid", F.struct("n", context_block().alias("block")).alias("b"))
    ordered = F.array_sort(F.collect_list("b"))
    return blocks.groupBy("qid").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), separator).alias("context"),
        F.count(F.lit(1)).alias("blocks"),
    )


def conversation_context(messages: DataFrame, max_turns: int, run_length: int = 256) -> DataFrame:
    """For each user message the ``max_turns`` messages before it, oldest first.

    ``messages`` is (conversation_id, turn, role, content) with integer turns, unique within a
    conversation; gaps are fine. Roles are renamed for the model. A conversation is worked on in
    runs of turns, and each run starts from the tail of the runs before it, so one very long
    conversation spreads over many tasks.
    """
    run = floor_div("turn", run_length)
    role = F.col("role")
    for ours, theirs in MODEL_ROLES.items():
        role = F.when(role == ours, theirs).otherwise(role)
    item = F.struct(F.col("turn"), role.alias("role"), F.col("content"))
    rows = messages.withColumns({"_run": run, "_item": item})
    in_run = Window.partitionBy("conversation_id", "_run").orderBy("turn")
    before = F.collect_list("_item").over(in_run.rowsBetween(-max_turns, -1))

    def tail(items: Column) -> Column:
        return bind(items, lambda a: F.slice(a, F.greatest(F.size(a) - max_turns + 1, F.lit(1)), max_turns))

    # The last messages of every run; their number is bounded by max_turns, so the carry is small.
    last_first = Window.partitionBy("conversation_id", "_run").orderBy(F.col("turn").desc())
    tails = (
        rows.withColumn("_back", F.row_number().over(last_first))
        .filter(F.col("_back") <= max_turns)
        .groupBy("conversation_id", "_run")
        .agg(F.array_sort(F.collect_list("_item")).alias("_tail"))
    )
    earlier_runs = Window.partitionBy("conversation_id").orderBy("_run").rowsBetween(-max_turns, -1)
    carry = tails.select(
        "conversation_id", "_run", tail(F.flatten(F.collect_list("_tail").over(earlier_runs))).alias("_carry")
    )
    asked = rows.withColumn("_before", before).filter("role = 'user'")
    history = tail(F.concat("_carry", "_before"))
    return asked.join(carry, ["conversation_id", "_run"]).select(
        "conversation_id", "turn", "content", history.alias("history")
    )


def _markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKER), 1)


def parse_citations(answers: DataFrame) -> DataFrame:
    """One row per answer and distinct marker: marker, n, first position (from 1) and count.

    ``n`` is null for a number that does not fit an integer. Works within the row.
    """
    all_markers = _markers(F.col("text"))
    distinct = bind(
        all_markers,
        lambda ms: F.transform(
            F.array_distinct(ms),
            lambda m: F.struct(
                m.alias("marker"),
                m.try_cast("int").alias("n"),
                F.array_position(ms, m).cast("int").alias("position"),
                F.size(F.filter(ms, lambda x: x == m)).alias("count"),
            ),
        ),
    )
    return answers.select("qid", F.inline(distinct))


def _without_unknown(text: str, known: frozenset[int]) -> str:
    """Take out markers of numbers that are not known, each with one blank before it, in one pass.

    What is kept so far ends in the innermost open bracket and its digits; a closing bracket then completes a
    marker, also one that only came about because another was taken out from within it.
    """
    kept: list[str] = []
    opened: list[int] = []  # where a bracket with nothing but digits behind it stands in ``kept``
    for sign in text:
        if sign == "[":
            opened.append(len(kept))
        elif sign == "]":
            start = opened.pop() if opened else None
            if start is not None and len(kept) > start + 1:
                n = int("".join(kept[start + 1 :]))
                if n not in known:
                    del kept[start:]
                    if kept and kept[-1] == " ":
                        kept.pop()
                    continue
            opened.clear()
        elif sign not in "0123456789":
            opened.clear()
        kept.append(sign)
    return "".join(kept)


@F.pandas_udf(T.StringType())
def _cleaned(texts: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _without_unknown(t, frozenset(map(int, k))) for t, k in zip(texts, known)], dtype=object)


def validate_citations(answers: DataFrame, supplied: DataFrame) -> DataFrame:
    """Check every answer's markers against the blocks it was given.

    ``answers`` is (qid, text); ``supplied`` is (qid, n, chunk_id, document_id, page_start,
    page_end). Result: qid, text without unknown markers, ``citations`` (one entry per cited block,
    by n), ``unknown`` markers, ``uncited`` when no valid marker is left. One join on qid; the
    blocks of a question are bounded by k.
    """
    block = F.struct("n", "chunk_id", "document_id", "page_start", "page_end")
    given = supplied.groupBy("qid").agg(F.array_sort(F.collect_list(block)).alias("_given"))
    joined = answers.select("qid", "text").join(given, "qid", "left")
    numbers = F.coalesce(F.transform("_given", lambda b: b["n"]), F.array().cast("array<int>"))

    def unknown_in(text: Column, allowed: Column) -> Column:
        def is_unknown(m: Column) -> Column:
            return ~F.coalesce(F.array_contains(allowed, m.try_cast("int")), F.lit(False))

        return F.filter(F.array_distinct(_markers(text)), is_unknown)

    staged = joined.withColumn("_numbers", numbers).withColumn("unknown", unknown_in(F.col("text"), F.col("_numbers")))
    clean = F.when(F.size("unknown") > 0, _cleaned("text", "_numbers")).otherwise(F.col("text"))
    cleaned = staged.withColumn("text", clean)
    cited = F.transform(_markers(F.col("text")), lambda m: m.try_cast("int"))
    found = F.filter("_given", lambda b: F.coalesce(F.array_contains(F.col("_cited"), b["n"]), F.lit(False)))
    given_type = given.schema["_given"].dataType
    citations = F.coalesce(found, F.array().cast(given_type))
    return (
        cleaned.withColumn("_cited", cited)
        .withColumn("citations", citations)
        .select("qid", "text", "citations", "unknown", (F.size("citations") == 0).alias("uncited"))
    )
