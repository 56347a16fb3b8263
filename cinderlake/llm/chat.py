r"""Chat formatting: logged conversations that are a prefix of a longer one collapse into it; the rest is rendered.

A service that logs the whole conversation after every turn leaves a chain of snapshots, each a prefix of the next.
Each turn gets two rolling 64-bit hashes of its conversation up to it: the exclusive or of hashes of position, role
and text. Conversations whose end occurs inside another one are removed by an anti-join on position and hashes; of
equal conversations the one with the smallest id stays. Turns are put in order by ranges and stored with
their place, whatever their numbers; positions and rolling hashes are computed in blocks of places, then over the
block totals, and long conversations are rendered in parts, so no task needs a whole one.

Turns are ordered by turn, then role, then text; nulls first. A null role is ``unknown``, a null text empty. Rows
without a conversation id are left out. Repeated rows are turns of their own. In roles and texts ``<|`` is written
``<\|``, and ``<\`` with one more backslash, so that no text holds a marker of a turn and each can be read back.
Texts are whole, however long; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.llm.common import Stored, column

BLOCK, PART = 256, 256
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def rolling(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, pos, role, text, p1, p2, total)``: turns with position from 1, rolling hashes and the number of turns."""
    rows = turns.where(column(turns, conv_col).isNotNull()).select(
        column(turns, conv_col).cast("long").alias("conv"), column(turns, turn_col).cast("long").alias("turn"),
        F.coalesce(column(turns, role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(column(turns, text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = ("conv", "turn", "role", "text", "tie")  # the last one deals out equal rows too
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    lines = Stored(placed.select("conv", "role", "text", F.monotonically_increasing_id().alias("line")), "turns").df
    rows = lines.withColumn("block", F.floor(F.col("line") / BLOCK))
    inside = Window.partitionBy("conv", "block").orderBy("line")
    numbered = rows.withColumn("k", F.row_number().over(inside))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(whole).alias("total"))
    placed = numbered.join(blocks, ["conv", "block"]).withColumn("pos", F.col("first") + F.col("k"))
    marked = placed.withColumn("h1", F.xxhash64("pos", "role", "text")).withColumn("h2", F.xxhash64(F.lit(7), "text", "pos", "role"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = marked.withColumn("w1", F.bit_xor("h1").over(so_far)).withColumn("w2", F.bit_xor("h2").over(so_far))
    sums = marked.groupBy("conv", "block").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    sums = sums.select("conv", "block", *(F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)))
    out = within.join(sums, ["conv", "block"])
    return out.select("conv", "pos", "role", "text", F.col("w1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("w2").bitwiseXOR(F.col("b2")).alias("p2"), "total")


def maximal(rolled: DataFrame) -> DataFrame:
    """``(conv, total)`` of the conversations that no longer one begins with; of equal ones the smallest id."""
    ends = rolled.where(F.col("pos") == F.col("total")).groupBy("pos", "p1", "p2").agg(F.min("conv").alias("conv"))
    inner = rolled.where(F.col("pos") < F.col("total")).select("pos", "p1", "p2").distinct()
    return ends.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv", F.col("pos").alias("total"))


def render(turns: DataFrame, part: int = PART, **columns: str) -> DataFrame:
    """``(conv, part, n_turns, rendered)`` of the maximal conversations, ``part`` turns in a row of the result.

    Only what the hashes need is read to choose them; then their turns alone are gathered.
    """
    rolled = Stored(rolling(turns, **columns), "rolled").df
    chosen = maximal(rolled.drop("role", "text")).select("conv")
    lines = rolled.join(chosen, "conv", "left_semi").select(
        "conv", F.floor((F.col("pos") - 1) / part).cast("int").alias("part"), "pos", "total",
        F.concat(F.lit(START), escaped(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n")).alias("line"),
    )
    gathered = lines.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"), F.max("total").alias("n_turns"))
    return gathered.select("conv", "part", "n_turns", F.array_join(F.col("lines.line"), "").alias("rendered"))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT *, string_agg(role || chr(31) || text || chr(30), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS total FROM t
), ends AS (
  SELECT pos, prefix, min(conv_id) AS conv_id FROM r WHERE pos = total GROUP BY pos, prefix
), kept AS (
  SELECT conv_id FROM ends e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pos = e.pos AND r.prefix = e.prefix AND r.pos < r.total)
)
SELECT conv_id, ((pos - 1) // 256)::INTEGER AS part, max(total) AS n_turns,
       string_agg('<|im_start|>' || replace(replace(role, '<\', '<\\'), '<|', '<\|') || chr(10) || replace(replace(text, '<\', '<\\'), '<|', '<\|') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM r SEMI JOIN kept USING (conv_id) GROUP BY conv_id, (pos - 1) // 256
"""
