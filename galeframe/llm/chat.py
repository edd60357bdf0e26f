"""Operator 3, chat formatting: preference pairs with a common prompt and masked completions, with DataFrame operations only.

The turns of the chosen and the rejected conversation are put in order. Their longest common prefix of turns (same
role, same text) is rendered once as the prompt; what follows is rendered as the two completions. A mask gives the
spans of a completion, in characters, that are trained on: what the assistant says, with its end mark.

Defined results: turns are ordered by turn (nulls first), role and text; rows that are repeated count once; a null role is
'user' and a null text is ''; without a partner the other side is null and the whole conversation is completion; two
equal conversations have empty completions; turns of a null conversation are in no pair; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _rendered(turns: str) -> Column:
    return F.expr(f"array_join(transform({turns}, x -> concat('{OPEN}', x.role, '\\n', x.text, '<|im_end|>\\n')), '')")


def _mask(turns: str) -> Column:
    """Spans of the assistant's texts with their end marks, in characters of the rendered turns."""
    head = f"{len(OPEN + AFTER_ROLE)} + length(x.role)"
    return F.expr(f"""aggregate({turns}, named_struct('at', 0, 'out', cast(array() as array<struct<start: int, end: int>>)),
      (s, x) -> named_struct('at', s.at + {head} + length(x.text) + {len(CLOSE)},
        'out', if(x.role = 'assistant', array_append(s.out, named_struct('start', s.at + {head}, 'end', s.at + {head} + length(x.text) + {len(CLOSE)})), s.out)),
      s -> s.out)""")


def preference_pairs(turns: DataFrame, pair_of: Column, is_chosen: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_common, prompt, chosen, chosen_mask, rejected and rejected_mask, a row for each pair. pair_of and is_chosen tell the pair and the side of a row."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(pair_of.alias("pair_id"), is_chosen.alias("_c"), F.col(conv_col).alias("_id"), turn.alias("_t"))
    side = lambda on, what: F.when(F.col("_c") == on, F.col(what))
    pairs = rows.groupBy("pair_id").agg(F.min(side(True, "_id")).alias("chosen_id"), F.min(side(False, "_id")).alias("rejected_id"), F.array_sort(F.collect_set(side(True, "_t"))).alias("_a"), F.array_sort(F.collect_set(side(False, "_t"))).alias("_b"))
    same = "zip_with(slice(_a, 1, least(size(_a), size(_b))), slice(_b, 1, least(size(_a), size(_b))), (x, y) -> x.role = y.role and x.text = y.text)"
    pairs = pairs.withColumn("_same", F.expr(same)).withColumn("n_common", F.expr("cast(if(array_position(_same, false) = 0, size(_same), array_position(_same, false) - 1) as int)"))
    pairs = pairs.withColumn("_x", F.expr("slice(_a, n_common + 1, size(_a))")).withColumn("_y", F.expr("slice(_b, n_common + 1, size(_b))")).withColumn("_p", F.expr("slice(_a, 1, n_common)"))
    has = lambda c, e: F.when(F.col(c).isNotNull(), e)
    return pairs.select("pair_id", "chosen_id", "rejected_id", "n_common", _rendered("_p").alias("prompt"), has("chosen_id", _rendered("_x")).alias("chosen"), has("chosen_id", _mask("_x")).alias("chosen_mask"), has("rejected_id", _rendered("_y")).alias("rejected"), has("rejected_id", _mask("_y")).alias("rejected_mask"))


def mask_text(mask: str) -> Column:
    """A mask as text, like 25-60,99-120."""
    return F.expr(f"array_join(transform({mask}, x -> concat(x.start, '-', x.end)), ',')")
