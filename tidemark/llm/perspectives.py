"""Dialogues rendered from the perspective of every participant (operator 2).

Participants are the distinct roles of a conversation except `system`. For each of them the whole dialogue is rendered with
that speaker as assistant and all others as named users; system turns stay system turns. The mask gives for every turn
`skip:learn` characters: headers and others' turns are skipped, the speaker's text with its end mark is learned.

A dialogue is written in parts of `PART` turn numbers, so that a row's size does not grow with the conversation; its parts in
order are the whole dialogue. Turns are ordered by (turn, role, text), nulls first; repeated rows are repeated turns. A
null role is the user `unknown` and no participant, a null text is empty, a null turn belongs to part -1, a null conv_id is
a conversation of its own. A conversation without participants has no perspective and gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 512


def rotate(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, mask."""
    t = turns.select("conv_id", "turn", "role", "text")
    number = F.coalesce(F.floor(F.col("turn") / part), F.lit(-1))
    pieces = (t.groupBy("conv_id", number.cast("long").alias("part"))
              .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))
    speakers = (t.where("role is not null and role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct())
    both = pieces.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))

    def header(x):
        return (F.when(x["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).when(x["role"] == "system", F.lit("<|system|>\n"))
                .otherwise(F.concat(F.lit("<|user name="), F.coalesce(x["role"], F.lit("unknown")), F.lit("|>\n"))))

    def body(x):
        return F.concat(F.coalesce(x["text"], F.lit("")), F.lit("<|end|>\n"))

    def mask(x):
        own = F.coalesce(x["role"] == F.col("speaker"), F.lit(False))
        return F.concat_ws(":", F.length(header(x)) + F.when(own, 0).otherwise(F.length(body(x))), F.when(own, F.length(body(x))).otherwise(0))

    return both.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"),
                       F.array_join(F.transform("turns", lambda x: F.concat(header(x), body(x))), "").alias("text"),
                       F.array_join(F.transform("turns", mask), ",").alias("mask"))
