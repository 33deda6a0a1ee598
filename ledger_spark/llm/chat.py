"""Multi-party perspective rotation: every dialogue once for each of its participants, with that speaker as assistant.

A perspective is a table of segments, one for each turn: header, text and end mark. The participant's turns have the
assistant header and are masked for training (text and end mark); turns of the others are a user's, with their name;
system turns stay system turns and nobody's perspective. start_char and end_char place a segment in the rendered
dialogue, mask_start and mask_end the trained characters. `dialogues` joins segments to texts, the longest in parts.

Texts and names cannot forge a turn: in both, `<|im_` is written `<\\|im_`, and line ends in names are blanks.

A dialogue is cut into blocks of turns. Lengths are summed per block and speaker before they are shuffled, so a
dialogue of any length is spread over tasks; the result has as many segments as turns times participants. Null roles
are the participant "unknown", one with any speaker of that name; null texts are empty. A null turn comes before all
others, negative ones too; rows without conv_id are one dialogue. Repeated turns are kept, ordered by role and text. A dialogue of system
turns only has no perspective. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|im_end|>\n"
BLOCK = 256
MARK, SAFE = "<|im_", "<\\|im_"
PART = 1 << 24


def _header(kind: str, name: Column | None = None) -> Column:
    return F.lit(f"<|im_start|>{kind}\n") if name is None else F.concat(F.lit(f"<|im_start|>{kind} name="), F.translate(F.replace(name, F.lit(MARK), F.lit(SAFE)), "\r\n", "  "), F.lit("\n"))


def rotated(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, participant, turn, role, name, segment, start_char, end_char, mask_start, mask_end."""
    role, text = F.coalesce("role", F.lit("unknown")), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(SAFE))
    system = F.col("speaker") == "system"
    rows = turns.select("conv_id", "turn", role.alias("speaker"), text.alias("text"), F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 63))).alias("block"))
    heads = rows.withColumn("other", F.when(system, _header("system")).otherwise(_header("user", F.col("speaker"))))
    heads = heads.withColumn("own", F.when(system, F.col("other")).otherwise(_header("assistant")))
    length = [(F.length(h) + F.length("text") + len(END)).alias(f"{h}_len") for h in ("other", "own")]
    sums = heads.select("conv_id", "block", "speaker", *length).groupBy("conv_id", "block", "speaker").agg(F.sum("other_len").alias("other_len"), F.sum("own_len").alias("own_len"))

    blocks = sums.groupBy("conv_id", "block").agg(F.sum("other_len").alias("all_len"))
    people = sums.filter(~system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("participant")).distinct()
    each = blocks.join(people.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "speaker", (F.col("own_len") - F.col("other_len")).alias("more"))
    each = each.join(own.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("participant") == F.col("speaker")), "left")
    before = Window.partitionBy("conv_id", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("all_len") + F.coalesce("more", F.lit(0))
    bases = each.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "participant", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("base"))

    joined = heads.join(bases.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    mine = F.col("speaker") == F.col("participant")
    head = F.when(mine, F.col("own")).otherwise(F.col("other"))
    joined = joined.withColumn("segment", F.concat(head, "text", F.lit(END)))
    down = Window.partitionBy("conv_id", "block", "participant").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum(F.length("segment")).over(down)
    out = joined.withColumn("end_char", end).withColumn("start_char", F.col("end_char") - F.length("segment"))
    return out.select(
        "conv_id", "participant", "turn", F.when(mine, "assistant").when(system, "system").otherwise("user").alias("role"), F.when(~mine & ~system, F.col("speaker")).alias("name"),
        "segment", "start_char", "end_char", F.when(mine, F.col("start_char") + F.length("own")).alias("mask_start"), F.when(mine, F.col("end_char")).alias("mask_end"),
    )


def dialogues(segments: DataFrame, part_chars: int = PART) -> DataFrame:
    """conv_id, participant, part, text, masks (start, end in text): rendered perspectives. Segments that start in one
    stretch of part_chars characters are a part, so that no row holds a dialogue of any length."""
    place = F.floor(F.col("start_char") / part_chars).alias("part")
    turns = F.sort_array(F.collect_list(F.struct("start_char", "end_char", "segment", "mask_start", "mask_end")))
    each = segments.groupBy("conv_id", "participant", place).agg(turns.alias("t"), F.min("start_char").alias("base"))
    masks = F.transform(F.filter("t", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct((x["mask_start"] - F.col("base")).alias("start"), (x["mask_end"] - F.col("base")).alias("end")))
    return each.select("conv_id", "participant", "part", F.array_join(F.col("t.segment"), "").alias("text"), masks.alias("masks"))


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, participant, part, text, masks (as start-end, parted by blanks)."""
    spans = F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return dialogues(rotated(turns)).withColumn("masks", F.array_join(spans, " "))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<\\|im_') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS participant FROM t WHERE speaker <> 'system'),
s AS (SELECT conv_id, participant, turn, speaker, text,
        CASE WHEN speaker = participant THEN '<|im_start|>assistant' || chr(10) WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
             ELSE '<|im_start|>user name=' || translate(replace(speaker, '<|im_', '<\\|im_'), chr(13) || chr(10), '  ') || chr(10) END AS head
      FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment,
        sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)::BIGINT AS end_char FROM s),
o AS (SELECT *, end_char - length(segment) AS start_char, (end_char - length(segment)) // 16777216 AS part FROM r)
SELECT conv_id, participant, part::BIGINT AS part, string_agg(segment, '' ORDER BY end_char) AS text,
       coalesce(string_agg(CASE WHEN speaker = participant THEN (start_char + length(head) - base)::VARCHAR || '-' || (end_char - base)::VARCHAR END, ' ' ORDER BY end_char), '') AS masks
FROM (SELECT *, min(start_char) OVER (PARTITION BY conv_id, participant, part) AS base FROM o) GROUP BY conv_id, participant, part
"""
