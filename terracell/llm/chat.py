"""Chat formatting: conversations logged turn by turn, of which only the longest are kept and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracell.llm.common import carried

TEMPLATE = "<|{role}|>\n{text}\n"


def turn_code(role: Column, text: Column) -> Column:
    """One string for a turn, different for any two turns: a role is written with its length, a null by a mark of its own."""
    own = F.coalesce(F.concat(F.lit("="), F.octet_length(role).cast("string"), F.lit(":"), role), F.lit("-"))
    return F.concat(own, F.coalesce(F.concat(F.lit("="), text), F.lit("-")))


def hashed_prefixes(turns: DataFrame) -> DataFrame:
    """(_row, conv_id, role, text, depth, prefix) of turns: depth from 1, and a hash of the conversation's turns up to this one.

    A turn's code and depth give 256 bits of SHA-2; the rolling hash is a sum of 60-bit pieces of these, so that a
    window's running sum gives every prefix in one pass; two sums of separate pieces are kept, 120 bits in all.
    Rows are ordered by turn, role and text, nulls first. _row has turns' own columns. A conversation is in one
    task, sorted on disk if it doesn't fit in memory; its turns are never one value.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = carried(turns, "conv_id", "turn", "role", "text").withColumn("depth", F.row_number().over(order))
    rows = rows.withColumn("_digest", F.sha2(F.concat(F.col("depth").cast("string"), turn_code(F.col("role"), F.col("text"))), 256))
    piece = lambda at: F.expr(f"cast(conv(substring(_digest, {at}, 15), 16, 10) as decimal(38,0))")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("prefix", F.concat_ws(":", *[F.sum(piece(at)).over(upto).cast("string") for at in (1, 16)])).drop("_digest", "turn")


def _kept(turns: DataFrame) -> DataFrame:
    """hashed_prefixes() of the conversations that maximal() keeps."""
    rows = hashed_prefixes(turns)
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "prefix")).alias("end"))
    distinct = ends.groupBy("end.depth", "end.prefix").agg(F.min("conv_id").alias("_keep"))
    last = F.max("depth").over(Window.partitionBy("conv_id"))
    proper = rows.select("conv_id", "depth", "prefix").withColumn("_n", last).where("depth < _n").select("depth", "prefix").distinct()
    chosen = distinct.join(proper, ["depth", "prefix"], "left_anti").select("_keep")
    return rows.join(chosen, F.col("conv_id").eqNullSafe(F.col("_keep")), "left_semi")


def maximal(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, ...) of the conversations to keep, with their own columns only.

    A conversation goes if its turns (roles and texts, in order) begin a longer one; of equal ones the
    smallest conv_id stays (null only if there is no other). Equal conversations are one row, and so are equal
    proper prefixes, before both meet in an anti-join: a first turn that many conversations share is one row.
    Repeated turn rows are turns of their own; a null conv_id is one conversation; a null role or text differs
    from an empty one.
    """
    return _kept(turns).select("_row.*")


def rendered(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, text): the kept conversations, each turn as the template says, null role and text as empty.

    No turns give no rows. A conversation's text is one value, as the result asks.
    """
    before, rest = template.split("{role}")
    between, after = rest.split("{text}")
    turn: Column = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(between), F.coalesce("text", F.lit("")), F.lit(after))
    parts = F.array_sort(F.collect_list(F.struct("depth", turn.alias("part"))))
    return _kept(turns).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("text"))


#: The same rows in DuckDB, by comparing lists of turns.
ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, list([coalesce('=' || role, '-'), coalesce('=' || text, '-')] ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM conversations GROUP BY conv_id
), p AS (
  SELECT DISTINCT t[1:i] AS t FROM (SELECT t, unnest(range(1, len(t))) AS i FROM c)
), k AS (
  SELECT min(conv_id) AS conv_id FROM (SELECT c.* FROM c ANTI JOIN p ON c.t = p.t) GROUP BY t
)
SELECT c.conv_id, CAST(len(c.t) AS BIGINT) AS n_turns, c.rendered AS text FROM c JOIN k ON c.conv_id IS NOT DISTINCT FROM k.conv_id
"""
