"""Chat formatting with cumulative-snapshot collapse. DataFrame functions only.

Logs often hold the same conversation several times, each snapshot a turn or more longer. A rolling hash gives
every turn prefix of a conversation its id; a conversation whose whole id is a proper prefix of another goes (anti-join),
and of equal ones the least conv_id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _coded(c: str):
    """A text with its length before it, so that no two different lists of turns read alike; null differs from empty."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of turn, role, text in order), ids (hash of each turn prefix)."""
    turn = F.struct("turn", "role", "text", F.sha2(F.concat(_coded("role"), F.lit("|"), _coded("text")), 256).alias("h"))
    grouped = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    rolled = F.aggregate("turns", F.array().cast("array<string>"), lambda ids, t: F.concat(ids, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(ids, F.lit(-1)), F.lit("")), t["h"]), 256))))
    return grouped.select("conv_id", "turns", rolled.alias("ids"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text of the maximal conversations.

    A turn is rendered <|role|>, new line, text, <|end|>, new line; null role: unknown, null text: empty. Rows
    that repeat a whole turn count once; different turns with one number stand in order of role, then text. A
    null turn number comes first. Rows without conv_id take no part. Texts of any length are rendered whole; an empty table gives no
    rows. Other columns play no part. The hashes of a conversation's prefixes are rolled within its row, so its turns must fit one.
    """
    convs = conversations(turns)
    known = convs.select("conv_id", F.element_at("ids", -1).alias("id"), "ids")
    prefixes = known.select(F.explode(F.slice("ids", F.lit(1), F.size("ids") - 1)).alias("id")).distinct()
    maximal = known.groupBy("id").agg(F.min("conv_id").alias("conv_id")).join(prefixes, "id", "left_anti").select("conv_id")
    line = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))
    text = F.array_join(F.transform("turns", line), "")
    return convs.join(maximal, "conv_id").select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("text"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(COALESCE(length(role) || ':' || role, '-') || '|' || COALESCE(length(text) || ':' || text, '-') || ';', '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS code,
             string_agg('<|' || COALESCE(role, 'unknown') || '|>' || chr(10) || COALESCE(text, '') || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, text FROM c
WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.conv_id <> c.conv_id AND starts_with(o.code, c.code) AND (o.n_turns > c.n_turns OR o.conv_id < c.conv_id))
"""
