"""Chat formatting of preference pairs, in DataFrame functions.

A pair is a chosen and a rejected conversation under one pair_id.  The turns
that both begin with alike (role and text) are rendered once, as the prompt; of
each conversation the rest is a completion, with the character spans of its
assistant turns (text and closing line end), which are the ones to train on.

A turn is rendered as ``<|role|>``, a line end, the text, a line end.

Edge cases: null texts and roles are empty; turns of equal number are ordered by
role and text; equal conversations give empty completions; a pair with one side
only has a null other side and no prompt; rows without a pair_id belong to no
pair; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

TRAINED = "assistant"


def _conversations(turns: DataFrame, name: str) -> DataFrame:
    """One row a pair_id: its turns in order, as an array of (role, text)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.filter("pair_id is not null").groupBy("pair_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("pair_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias(name))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def _spans(turns: Column) -> Column:
    """start:end of the trained turns, comma-joined."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        body = acc["at"] + F.length(t["role"]) + 5
        end = body + F.length(t["text"]) + 1
        span = F.concat(body.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add, lambda acc: F.array_join(acc["spans"], ","))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """From turns (pair_id, turn, role, text) of both sides: pair_id, n_prefix, prompt, completions and their trained spans."""
    both = _conversations(chosen, "chosen").join(_conversations(rejected, "rejected"), "pair_id", "full")
    differs = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b)), False)
    n = F.when(differs > 0, differs - 1).otherwise(F.size("chosen")).cast("int")
    whole = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    both = both.withColumn("n_prefix", F.when(whole, n).otherwise(F.lit(0)))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_prefix") + 1, F.greatest(F.size(side), F.lit(0)))

    return both.select(
        "pair_id",
        "n_prefix",
        F.when(whole, _rendered(F.slice("chosen", F.lit(1), F.col("n_prefix")))).otherwise("").alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"),
        _spans(rest("chosen")).alias("chosen_spans"),
        _rendered(rest("rejected")).alias("rejected"),
        _spans(rest("rejected")).alias("rejected_spans"),
    )


def op9_preferences(spark, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are the pair k."""
    turns = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.col("conv_id") % 2).alias("side"), "turn", "role", "text")
    return format_pairs(turns.filter("side = 0"), turns.filter("side <> 0"))


OP9_SQL = """
WITH turns AS (
    SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS k FROM turns
), prefix AS (
    SELECT p.pair_id, CASE WHEN p.c = 0 OR p.r = 0 THEN 0 ELSE coalesce(d.first_difference - 1, p.c) END AS n_prefix, p.c, p.r
    FROM (SELECT pair_id, count(*) FILTER (side = 0) AS c, count(*) FILTER (side <> 0) AS r FROM numbered GROUP BY pair_id) p
    LEFT JOIN (
        SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.k, b.k)) AS first_difference
        FROM (SELECT * FROM numbered WHERE side = 0) a FULL JOIN (SELECT * FROM numbered WHERE side <> 0) b ON a.pair_id = b.pair_id AND a.k = b.k
        WHERE a.k IS NULL OR b.k IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY 1
    ) d ON p.pair_id = d.pair_id
), parts AS (
    SELECT n.pair_id, side, k, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS shown, length(role) + 5 AS lead, n_prefix, k > n_prefix AS rest
    FROM numbered n JOIN prefix p ON n.pair_id = p.pair_id
), placed AS (
    SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side, rest ORDER BY k) AS stop FROM parts
)
SELECT p.pair_id, CAST(p.n_prefix AS INTEGER) AS n_prefix,
    coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND NOT rest), '') AS prompt,
    CASE WHEN p.c > 0 THEN coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND rest), '') END AS chosen,
    CASE WHEN p.c > 0 THEN coalesce(string_agg(CAST(CAST(stop - length(shown) + lead AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (side = 0 AND rest AND role = 'assistant'), '') END AS chosen_spans,
    CASE WHEN p.r > 0 THEN coalesce(string_agg(shown, '' ORDER BY k) FILTER (side <> 0 AND rest), '') END AS rejected,
    CASE WHEN p.r > 0 THEN coalesce(string_agg(CAST(CAST(stop - length(shown) + lead AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (side <> 0 AND rest AND role = 'assistant'), '') END AS rejected_spans
FROM placed q JOIN prefix p ON q.pair_id = p.pair_id
GROUP BY p.pair_id, p.n_prefix, p.c, p.r
"""
