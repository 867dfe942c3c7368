"""Conversation history: windows of messages, filters and sticky attributes.

Messages are (client_id, session_id, ord, role, content); ord orders a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import contains_any

# Replies that decline, and the ending of a clarification.
DECLINE_MARKERS = ("معذرة", "آسف", "مش واضح", "مش متأكد", "مش متخصص", "برا التخصص", "مش بنقدم", "حد من الفريق")
CLARIFICATION_SUFFIX = "تحب أي نوع فيهم؟"

SESSION = ("client_id", "session_id")


def last_messages(messages: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """(client, session, history): each session's last n messages, oldest first."""
    newest = Window.partitionBy(*SESSION).orderBy(F.desc(order))
    kept = messages.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= n)
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("ord"), "role", "content")))
    return kept.groupBy(*SESSION).agg(listed.alias("h")).select(*SESSION, F.transform("h", lambda m: F.struct(m["role"], m["content"])).alias("history"))


def rolling_history(messages: DataFrame, window: int = 6, order: str = "ord") -> DataFrame:
    """Each message with the session's last `window` messages up to it."""
    frame = Window.partitionBy(*SESSION).orderBy(order).rowsBetween(1 - window, 0)
    return messages.withColumn("history", F.collect_list(F.struct("role", "content")).over(frame))


def is_decline(content: Column, markers: tuple[str, ...] = DECLINE_MARKERS) -> Column:
    return contains_any(content, markers)


def is_clarification(content: Column, suffix: str = CLARIFICATION_SUFFIX) -> Column:
    return content.endswith(suffix)


def excluded_from_routing(content: Column) -> Column:
    """Turns that routing doesn't see: declines only, as a clarification tells what the answer to it means."""
    return is_decline(content)


def excluded_from_generation(content: Column) -> Column:
    """Turns that generation doesn't see: declines and clarifications."""
    return is_decline(content) | is_clarification(content)


def without_excluded(history: Column, excluded) -> Column:
    """An ordered history without excluded assistant turns and the user turn that each answers.

    The kept turns act as a stack: an excluded turn also removes the user turn then last, so two
    excluded turns in a row can remove two user turns in a row.
    """
    none = F.slice(history, 1, 0)

    def step(kept: Column, t: Column) -> Column:
        out = F.coalesce((t["role"] == "assistant") & excluded(F.coalesce(t["content"], F.lit(""))), F.lit(False))
        asked = F.coalesce(F.try_element_at(kept, F.lit(-1))["role"] == "user", F.lit(False))
        return F.when(~out, F.concat(kept, F.array(t))).when(asked, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)

    return F.aggregate(history, none, step)


def kept_turns(messages: DataFrame, excluded, order: str = "ord") -> DataFrame:
    """Messages with `nth` in their session and `kept`: the fold of `without_excluded` over sessions of any length.

    Kept turns other than the user's are never removed and hide what lies below, so they cut the
    stack into parts; in a part, a user turn goes if the number of turns on the stack later falls
    below the number with it.
    """
    nth = Window.partitionBy(*SESSION).orderBy(order, "role", "content")
    out = F.coalesce((F.col("role") == "assistant") & excluded(F.coalesce("content", F.lit(""))), F.lit(False))
    asked = F.coalesce(F.col("role") == "user", F.lit(False))
    x = messages.withColumn("nth", F.row_number().over(nth)).withColumn("_out", out).withColumn("_asked", asked)
    upto = Window.partitionBy(*SESSION).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_part", F.sum((~F.col("_out") & ~F.col("_asked")).cast("long")).over(upto))
    part = Window.partitionBy(*SESSION, "_part")
    x = x.withColumn("_size", F.sum(F.col("_asked").cast("long") - F.col("_out").cast("long")).over(part.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
    least = F.min("_size").over(part.orderBy(F.desc("nth")).rowsBetween(Window.unboundedPreceding, -1))
    kept = ~F.col("_out") & (~F.col("_asked") | (F.coalesce(least, F.col("_size")) >= F.col("_size")))
    return x.withColumn("kept", kept).drop("_out", "_asked", "_part", "_size")


def sticky(messages: DataFrame, column: str, clear: str = "all", order: str = "ord") -> DataFrame:
    """`column` as it holds after each message: null keeps the last value, `clear` drops it."""
    upto = Window.partitionBy(*SESSION).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(column, ignorenulls=True).over(upto)
    return messages.withColumn(column, F.when(held != clear, held))
