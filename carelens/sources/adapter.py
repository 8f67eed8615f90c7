"""Shape the driver's ``conversations`` table into a support message log.

``conversations(conv_id, turn, role, text)`` becomes the message schema
(``tweet_id, author_id, inbound, created_at, text, response_tweet_id,
in_response_to_tweet_id``) plus ``seq``, an ingest sequence used for
keep-last dedupe. Every expression here has a twin in the DuckDB oracle
CTE (``carelens.plans.oracle.MESSAGES_CTE``); change both together.

Rules:
* ``tweet_id = conv_id * TURNS + turn``, with ``TURNS = 2**24``: one conversation
  may hold any number of turns that fits in 24 bits, and the product is a
  checked 64-bit one (an id beyond it fails rather than wraps).
* ``inbound``: true for user turns, false for assistant turns, NULL for
  system turns (exercises three-valued filters).
* ``author_id``: ``'u' || conv_id % 37`` for users, brand
  ``BRANDS[conv_id % 5]`` for assistants, ``'system'`` otherwise.
* ``in_response_to_tweet_id``: the previous turn's id (``tweet_id - 1``
  when ``turn > 0``). Pure arithmetic, so no window over a conversation
  that might hold a third of all rows.
* ``response_tweet_id``: the next turn's id when that turn exists, found
  by a join on the unique ``(conv_id, turn)`` key (no hot keys).
* Perturbations after links are set: user turns ``<= 1`` of conversations
  with ``conv_id % 11 = 0`` are dropped (their replies become orphans);
  user turns of conversations with ``conv_id % 13 = 0`` get a second,
  edited copy with ``seq = 1`` (duplicate ids for keep-last dedupe).
* Text decoration so the cleaning, usefulness and rule operators have
  work: assistant turns get a handle, a closing sentence, a URL and agent
  initials; user turns get a support sentence picked by
  ``(2 * (conv_id % 5) + turn / 2) % 12`` (integer division), so each
  brand's customers raise their own mix of topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------
# FIXED VALUES (must equal the reference): the five candidate brands, in
# the reference's order.
BRANDS = ["AmazonHelp", "AppleSupport", "Uber_Support", "SpotifyCares", "Delta"]
# The single brand the training-sample steps pair for.
BRAND = "SpotifyCares"
# ---------------------------------------------------------------------

# Ids of one conversation: turns are numbered inside a block of this size.
TURNS = 1 << 24

# Our own decoration sentences (not taken from the reference).
ASSISTANT_CLOSERS = [
    " Can you DM us your email?",
    " We've sent you a bit more info over DM.",
    " Please restart the app and let us know.",
    "",
]
AGENT_INITIALS = ["LM", "AU", "JS"]
USER_SENTENCES = [
    "",
    " My app keeps crashing on android.",
    " I was charged twice this month, please refund.",
    " I forgot my password and cannot log in.",
    " Songs keep skipping and the audio stops.",
    " My playlist vanished after the sync.",
    " Please add a sleep timer feature.",
    " This album is not available in my country.",
    " Thanks for the help!",
    " Why is my premium subscription more expensive?",
    " The web player is stuck loading in my browser.",
    " Someone hacked my account, help.",
]


def _pick(values: list[str], index: Column) -> Column:
    """``values[index]`` as a CASE expression (codegen-friendly)."""
    expr = None
    for i, v in enumerate(values):
        expr = (F.when(index == i, F.lit(v)) if expr is None
                else expr.when(index == i, F.lit(v)))
    return expr


def messages_from_conversations(conversations: DataFrame) -> DataFrame:
    c = conversations.select("conv_id", "turn", "role", "text")
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    tweet_id = conv.cast("long") * TURNS + turn

    assistant_text = F.concat(
        F.lit("@u"), (conv % 37).cast("string"), F.lit(" "), F.col("text"),
        _pick(ASSISTANT_CLOSERS, conv % 4),
        F.lit(" https://t.co/"), conv.cast("string"), F.lit(" /"),
        _pick(AGENT_INITIALS, turn % 3),
    )
    topic = (F.lit(2) * (conv % 5) + F.floor(turn / 2)) % 12
    user_text = F.concat(F.col("text"), _pick(USER_SENTENCES, topic))

    base = c.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        role.alias("role"),
        tweet_id.alias("tweet_id"),
        F.when(role == "user", F.lit(True))
        .when(role == "assistant", F.lit(False)).alias("inbound"),
        F.when(role == "user", F.concat(F.lit("u"), (conv % 37).cast("string")))
        .when(role == "assistant", _pick(BRANDS, conv % 5))
        .otherwise(F.lit("system")).alias("author_id"),
        conv.cast("string").alias("created_at"),
        F.when(role == "assistant", assistant_text)
        .when(role == "user", user_text)
        .otherwise(F.col("text")).alias("text"),
        F.when(turn > 0, tweet_id - 1).alias("in_response_to_tweet_id"),
    )

    # Next-turn existence: join on the unique (conv_id, turn) key. The
    # right side is a DISTINCT, so Catalyst drops the join entirely when
    # a query does not read response_tweet_id.
    nxt = (c.select("conv_id", (F.col("turn") - 1).alias("turn"))
           .distinct().withColumn("has_next", F.lit(True)))
    linked = (base.join(nxt, ["conv_id", "turn"], "left")
              .withColumn("response_tweet_id",
                          F.when(F.col("has_next"),
                                 (F.col("tweet_id") + 1).cast("string"))))

    kept = linked.filter(~((F.col("role") == "user") & (F.col("turn") <= 1)
                           & (F.col("conv_id") % 11 == 0)))
    # Edited copies come from the same scan: each row explodes into its
    # ingest sequence numbers (0, plus 1 for duplicated user rows).
    dup = (F.col("role") == "user") & (F.col("conv_id") % 13 == 0)
    seqs = F.when(dup, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = kept.select("*", F.explode(seqs).alias("seq"))
    return rows.select(
        "tweet_id", "author_id", "inbound", "created_at",
        F.when(F.col("seq") == 1, F.concat(F.col("text"), F.lit(" (edited)")))
        .otherwise(F.col("text")).alias("text"),
        "response_tweet_id", "in_response_to_tweet_id", "seq")
