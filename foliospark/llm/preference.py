"""Chat formatting for preference training: one prompt, two masked completions.

The longest common turn prefix of a pair's chosen and rejected conversations is rendered once, as the prompt;
what follows it on either side is a completion, with the character spans that a loss should see: the assistant's
texts with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read
from .fingerprint import with_next

BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit(MIDDLE), text, F.lit(END))


def format_preferences(turns: DataFrame, key: str = "pair_id") -> DataFrame:
    """turns (``key``, side, turn, role, text) -> a row for each key that has turns.

    side is chosen or rejected (other rows are left out). Turns are in order of turn (null first), then role and
    text; null roles and texts are empty. Columns: the key, n_prompt_turns, prompt, chosen, rejected,
    chosen_spans and rejected_spans (arrays of begin and end, in characters of the completion, end exclusive).
    A side without turns beyond the prompt is an empty completion with no spans; so is a side that is missing.
    A null key is a key of its own, repeated turns are turns of their own, other columns are ignored. An
    example is one row, so a conversation must fit into one.
    """
    rows = turns.where(F.col("side").isin("chosen", "rejected")).select(F.col(key), "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy(key, "side").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("i", F.count("*").over(order)).withColumn("end", F.sum(F.char_length(_render(F.col("role"), F.col("text")))).over(order))
    one = F.struct("i", "role", "text", "end")
    side = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, one)))
    pairs = rows.groupBy(key).agg(side("chosen").alias("c"), side("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    pairs = pairs.withColumn("n", F.when(F.exists(same, lambda x: ~x), F.array_position(same, F.lit(False)).cast("int") - 1).otherwise(F.size("c")))
    joined = lambda x: F.array_join(F.transform(x, lambda t: _render(t["role"], t["text"])), "")
    pairs = pairs.withColumn("skip", F.coalesce(F.get("c", F.col("n") - 1)["end"], F.lit(0)))

    def completion(c: str) -> tuple[Column, Column]:
        rest = F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
        own = F.filter(rest, lambda t: t["role"] == TRAINED)
        spans = F.transform(own, lambda t: F.struct((t["end"] - F.col("skip") - F.char_length(t["text"]) - len(END)).cast("int").alias("begin"), (t["end"] - F.col("skip")).cast("int").alias("end")))
        return joined(rest), spans

    (chosen, chosen_spans), (rejected, rejected_spans) = completion("c"), completion("r")
    return pairs.select(key, F.col("n").cast("long").alias("n_prompt_turns"), joined(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"), chosen_spans.alias("chosen_spans"), rejected_spans.alias("rejected_spans"))


def mismatched_replies(conversations: DataFrame) -> DataFrame:
    """Preference pairs of a table of single conversations (conv_id, turn, role, text), for ``format_preferences``.

    Each conversation is the chosen one; the rejected one has the last assistant text of the next conversation
    (ascending conv_id, after the last the first) in place of its own. Conversations without an assistant turn
    or with a null conv_id give no pair.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    spoken = turns.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    replies = with_next(spoken.select("conv_id", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("reply")), "conv_id", ["last_turn", "reply"])
    both = turns.join(replies.select("conv_id", "last_turn", "reply", "next_reply"), "conv_id")
    swapped = (F.col("role") == TRAINED) & F.col("turn").eqNullSafe(F.col("last_turn")) & (F.coalesce("text", F.lit("")) == F.col("reply"))
    rejected = F.when(swapped, F.col("next_reply")).otherwise(F.col("text"))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("t")), F.struct(F.lit("rejected").alias("side"), rejected.alias("t"))))
    return both.select(F.col("conv_id").alias("pair_id"), "turn", "role", sides.alias("s")).select("pair_id", "s.side", "turn", "role", F.col("s.t").alias("text"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_preferences(mismatched_replies(read(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    return out.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans").alias("chosen_spans"), text("rejected_spans").alias("rejected_spans"))


_RENDER = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
ORACLE_SQL = {
    "op6_preference_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 a AS (SELECT conv_id, max(turn) AS last_turn FROM t WHERE role = 'assistant' GROUP BY conv_id),
 l AS (SELECT t.conv_id, t.turn AS last_turn, max(t.text) AS reply FROM t JOIN a ON t.conv_id = a.conv_id AND t.turn = a.last_turn WHERE t.role = 'assistant' GROUP BY t.conv_id, t.turn),
 n AS (SELECT *, coalesce(lead(reply) OVER (ORDER BY conv_id), first_value(reply) OVER (ORDER BY conv_id)) AS next_reply FROM l),
 b AS (SELECT t.conv_id, t.turn, t.role, t.text AS c, CASE WHEN t.role = 'assistant' AND t.turn = n.last_turn AND t.text = n.reply THEN n.next_reply ELSE t.text END AS r FROM t JOIN n ON t.conv_id = n.conv_id),
 i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, c) AS i, c IS DISTINCT FROM r AS differs FROM b),
 p AS (SELECT conv_id, coalesce(min(CASE WHEN differs THEN i END) - 1, count(*)) AS n FROM i GROUP BY conv_id),
 s AS (SELECT i.conv_id, i.i, p.n, 'c' AS side, role, c AS text FROM i JOIN p ON i.conv_id = p.conv_id UNION ALL SELECT i.conv_id, i.i, p.n, 'r', role, r FROM i JOIN p ON i.conv_id = p.conv_id),
 x AS (SELECT *, {_RENDER} AS shown, sum(CASE WHEN i > n THEN length({_RENDER}) ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM s)
SELECT conv_id AS pair_id, max(n)::BIGINT AS n_prompt_turns,
 coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= n), '') AS prompt,
 coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > n), '') AS chosen,
 coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'r' AND i > n), '') AS rejected,
 coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 'c' AND i > n AND role = 'assistant'), '') AS chosen_spans,
 coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 'r' AND i > n AND role = 'assistant'), '') AS rejected_spans
FROM x GROUP BY conv_id"""
}
