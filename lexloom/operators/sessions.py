"""Per-session history and request limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import domain as D
from .skew import lookback_blocks, split_rank


def session_context(turns: DataFrame, order: str = "turn", width: int = 1000, limit: int = D.SESSION_TURNS,
                    snippet: int = D.SESSION_SNIPPET_CHARS, block: int = 10_000) -> DataFrame:
    """Adds history_text, last_query, last_topic and turn_count of the turns before each turn.

    ``turns`` has session_id, query, answer, topic and an order column; ``width`` is the
    bucket of that column. A session of any length is cut into blocks that repeat
    the last ``limit`` turns, so the window never holds a whole hot session.
    """
    order_col = F.col(order)
    numeric = order_col.cast("double") if dict(turns.dtypes)[order].startswith("timestamp") else order_col
    ranked = split_rank(turns, ["session_id"], [order], F.floor(numeric / width), "_rank")
    w = Window.partitionBy("session_id", "_block").orderBy("_rank").rowsBetween(-limit, -1)
    line = F.concat(F.lit("Q: "), "query", F.lit("\nA: "), F.left(F.coalesce("answer", F.lit("")), F.lit(snippet)))
    entry = F.struct(F.col("_rank").alias("r"), line.alias("t"))
    past = F.array_sort(F.collect_list(entry).over(w))
    return (
        lookback_blocks(ranked, "_rank", limit, block)
        .withColumn("history_text", F.array_join(F.transform(past, lambda e: e["t"]), "\n\n"))
        .withColumn("last_query", F.last("query").over(w))
        .withColumn("last_topic", F.last("topic", ignorenulls=True).over(w))
        .withColumn("turn_count", F.count(F.lit(1)).over(w).cast("int"))
        .where(~F.col("_context")).drop("_context", "_block", "_rank")
    )


def rate_limit_violations(events: DataFrame, keys: list[str], at: str, limit: int, window_seconds: int,
                          span: int = 86_400) -> DataFrame:
    """Seconds in which a key exceeds ``limit`` distinct active seconds within the trailing window.

    Calls of one second count once, so calls are reduced to distinct seconds
    before the exchange. Time is cut into spans, each with the tail of the span
    before, so a hot client is spread over its spans.
    """
    span = max(span, window_seconds)
    sec = F.unix_seconds(F.col(at))
    seconds = events.select(*keys, sec.alias("second")).distinct()
    own = F.floor(F.col("second") / span)
    tail = (F.col("second") % span) >= span - window_seconds
    copies = F.filter(
        F.array(
            F.struct(own.alias("b"), F.lit(False).alias("c")), F.struct(F.when(tail, own + 1).alias("b"), F.lit(True).alias("c"))
        ),
        lambda x: x["b"].isNotNull(),
    )
    w = Window.partitionBy(*keys, "_span").orderBy("second").rangeBetween(-(window_seconds - 1), 0)
    return (
        seconds.withColumn("_x", F.explode(copies)).withColumn("_span", F.col("_x.b"))
        .withColumn("n_seconds", F.count(F.lit(1)).over(w))
        .where(~F.col("_x.c") & (F.col("n_seconds") > limit)).select(*keys, "second", "n_seconds")
    )


def last_messages(turns: DataFrame) -> DataFrame:
    """Latest message per role and a title from the first question, per conversation."""
    def by(fn, role):
        hit = F.col("role") == role
        return fn(F.when(hit, F.col("text")), F.when(hit, F.col("turn")))

    first = by(F.min_by, "user")
    g = turns.groupBy("conv_id").agg(
        by(F.max_by, "user").alias("last_user"), by(F.max_by, "assistant").alias("last_assistant"), first.alias("_first")
    )
    title = F.when(F.length("_first") > 60, F.concat(F.left("_first", F.lit(57)), F.lit("..."))).otherwise(F.col("_first"))
    return g.select("conv_id", "last_user", "last_assistant", title.alias("title"))
