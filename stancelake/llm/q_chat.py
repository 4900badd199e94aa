"""Query of the chat formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from .chat import canonical_turns, formatted, read_back
from .registry import query, table

SAMPLE = r"\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length('### ' || replace(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g'), chr(10), '\n') || chr(10)
                   || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10)) AS size FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def as_records(conversations):
    """Each row as a JSON record (conv_id, seq, record), its layout chosen by conversation.

    The table has rows by turn; three one-turn layouts stand in for sources that
    name and nest their fields differently.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    plain = F.to_json(F.struct(role.alias("role"), text.alias("content")))
    shared = F.to_json(F.struct(named.alias("from"), text.alias("value")))
    nested = F.to_json(F.struct(F.struct(role.alias("role")).alias("speaker"), F.struct(text.alias("text")).alias("body")))
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    # a role that is itself called human or gpt keeps the layout that doesn't rename roles
    record = F.when((kind == 1) & ~role.isin("human", "gpt"), shared).when(kind == 2, nested).otherwise(plain)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("seq"), record.alias("record"))


@query("op7_chat_format", CHAT_SQL)
def chat_format(spark, sf_dir):
    """All of ``conversations`` and conversation -7, formatted and read back."""
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("seq"),
                                F.to_json(F.struct(F.lit(SAMPLE).alias("prompt"), F.lit(SAMPLE).alias("completion"))).alias("record"))
    records = as_records(table(spark, sf_dir, "conversations")).unionByName(own)
    return read_back(formatted(canonical_turns(records)))
