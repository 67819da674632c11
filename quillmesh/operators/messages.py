"""Chat messages: token totals and the newest messages that fit a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import approx_tokens
from .ordered import running_sum

PER_MESSAGE = 3
TRUNCATE_ABOVE = 8


def message_cost(text: str = "text"):
    return (approx_tokens(text) + PER_MESSAGE).cast("bigint")


def token_totals(messages: DataFrame) -> DataFrame:
    """Estimated tokens per conversation."""
    return messages.groupBy("conv_id").agg(F.sum(message_cost()).alias("tokens"), F.count("*").alias("messages"))


def clamp_to_budget(messages: DataFrame, max_tokens: int) -> DataFrame:
    """(conv_id, turn, role, text, truncated) of the messages that stay.

    From the newest on, whole messages stay while they fit. The first that does not is
    cut to its tail and ends the walk if more than 8 tokens are left; otherwise it is
    skipped and older ones may still fit. Every message costs at least 3 tokens, so at
    most two older ones can: the fold becomes a running sum and two partial maxima, and
    no conversation is ever gathered in one place.
    """
    m = messages.select("conv_id", "turn", "role", "text", message_cost().alias("cost"))
    if max_tokens <= 0:
        return m.select("conv_id", "turn", "role", "text", F.lit(False).alias("truncated"))
    m = m.withColumn("_back", -F.col("turn")).withColumn("_s", F.floor(F.col("_back") / 4096))
    r = running_sum(m.drop("text", "role"), ["conv_id"], "_s", ["_back"], "cost", "used")

    fits = F.col("used") <= max_tokens
    stop = r.groupBy("conv_id").agg(
        F.max(F.when(~fits, F.col("turn"))).alias("stop_turn"), F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0)).alias("kept")
    )
    stop = stop.where(F.col("stop_turn").isNotNull()).select("conv_id", "stop_turn", (F.lit(max_tokens) - F.col("kept")).alias("slack"))
    cut = stop.where(F.col("slack") > TRUNCATE_ABOVE)
    skip = stop.where(F.col("slack") <= TRUNCATE_ABOVE)

    small = m.where(F.col("cost") <= TRUNCATE_ABOVE).select("conv_id", "turn", "cost")
    older = lambda bound: small.join(bound, "conv_id").where((F.col("turn") < F.col("stop_turn")) & (F.col("cost") <= F.col("slack")))
    newest = F.max_by(F.struct("turn", (F.col("slack") - F.col("cost")).alias("slack")), "turn").alias("p")
    first = older(skip).groupBy("conv_id").agg(newest).select("conv_id", F.col("p.turn").alias("stop_turn"), F.col("p.slack").alias("slack"))
    second = older(first).groupBy("conv_id").agg(newest).select("conv_id", F.col("p.turn").alias("stop_turn"), F.col("p.slack").alias("slack"))

    whole = r.where(fits).select("conv_id", "turn", F.lit(-1).cast("bigint").alias("tail"))
    picks = first.unionByName(second).select("conv_id", F.col("stop_turn").alias("turn"), F.lit(-1).cast("bigint").alias("tail"))
    tails = cut.select("conv_id", F.col("stop_turn").alias("turn"), (F.col("slack") * 4).alias("tail"))
    keep = whole.unionByName(picks).unionByName(tails)
    text = F.when(F.col("tail") >= 0, F.substring("text", F.greatest(F.length("text") - F.col("tail") + 1, F.lit(1)).cast("int"), F.col("tail").cast("int")))
    return messages.join(keep, ["conv_id", "turn"]).select(
        "conv_id", "turn", "role", F.coalesce(text, F.col("text")).alias("text"), (F.col("tail") >= 0).alias("truncated")
    )
