"""Queries on messages with tool calls and on schemas. Conversations stand for what a model was sent, turn by turn."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.operators import messages

from .catalog import query


def _conversations(table):
    """conv_id and messages: a user's turn is a text or blocks, an assistant's may call a tool, of whose calls every other is answered in the turn that follows."""
    c, t = table("conversations"), F.col("turn")
    none = F.lit(None).cast("string")
    block = lambda **v: F.struct(*[v.get(n, none).alias(n) for n in ("type", "text", "id", "name", "input", "tool_use_id", "content")])
    call_id = F.format_string("call-%d-%d", "conv_id", t)
    said = block(type=F.lit("text"), text=F.col("text"))
    call = block(type=F.lit("tool_use"), id=call_id, name=F.concat(F.lit("look_up_"), (t % 3).cast("string")), input=F.to_json(F.struct(F.length("text").alias("n"))))
    answer = block(type=F.lit("tool_result"), tool_use_id=F.format_string("call-%d-%d", F.col("conv_id"), t - 1), content=F.left("text", F.lit(9)))
    blocks = F.when(F.col("role") == "assistant", F.array(said, call)).when((t > 0) & (t % 4 == 2), F.array(answer, said))
    each = F.struct(t.alias("turn"), F.struct(F.col("role").alias("role"), F.when(blocks.isNull(), F.col("text")).alias("text"), blocks.alias("blocks")).cast(messages.MESSAGE).alias("m"))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(t.alias("turn"), each.alias("x")))), lambda x: x["x"]["m"]).alias("messages"))


_SAID = """
    b AS (SELECT *, role = 'assistant' AS calls, role <> 'assistant' AND turn > 0 AND turn % 4 = 2 AS answers FROM conversations),
    chat AS (SELECT conv_id, turn, 0 AS k, role AS r, text AS content, NULL AS call, NULL AS of_call FROM b WHERE NOT answers
             UNION ALL SELECT conv_id, turn, 1, 'assistant', NULL, 'call-' || conv_id || '-' || turn || ' look_up_' || (turn % 3) || ' {"n":' || length(text) || '}', NULL FROM b WHERE calls
             UNION ALL SELECT conv_id, turn, 0, 'tool', left(text, 9), NULL, 'call-' || conv_id || '-' || (turn - 1) FROM b WHERE answers
             UNION ALL SELECT conv_id, turn, 1, role, text, NULL, NULL FROM b WHERE answers)
"""


@query(f"WITH {_SAID} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS INTEGER) AS place, r AS role, content, call, of_call, TRUE AS round_trip FROM chat UNION ALL SELECT DISTINCT conv_id, 0, 'system', 'Be brief.', NULL, NULL, TRUE FROM conversations")
def chat_messages(table):
    """Both directions: conversations in the chat form, and whether the way back gives what was there."""
    c = _conversations(table).withColumn("chat", messages.to_chat(F.col("messages"), F.lit("Be brief.")))
    same = messages.from_chat(F.col("chat")).eqNullSafe(messages.apart(F.col("messages")))
    each = c.select("conv_id", same.alias("round_trip"), F.posexplode("chat").alias("place", "m"))
    call = F.col("m.tool_calls")[0]
    return each.select("conv_id", "place", "m.role", "m.content", F.concat_ws(" ", call["id"], call["function"]["name"], call["function"]["arguments"]).alias("c"), F.col("m.tool_call_id").alias("of_call"), "round_trip").withColumn("call", F.nullif("c", F.lit(""))).drop("c")


@query("""
    WITH a AS (SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS id, 'look_up_' || (turn % 3) AS name FROM conversations WHERE role = 'assistant')
    SELECT a.conv_id, a.id, a.name, left(r.text, 9) AS content FROM a LEFT JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1 AND r.turn % 4 = 2 AND r.role <> 'assistant'
""")
def tool_calls(table):
    """Calls of tools with their results, null where none came."""
    return _conversations(table).select("conv_id", F.explode(messages.tool_pairs(F.col("messages"))).alias("p")).select("conv_id", "p.*")


@query("""
    WITH RECURSIVE e(d, t, root) AS (SELECT 0, '{"additionalProperties":false,"properties":{},"type":"object"}', '{"additionalProperties":false,"properties":{},"type":"object"}' UNION ALL
        SELECT d + 1, head || t || list || tail, head || t || list || '"minItems":1,' || tail
        FROM (SELECT d, t, '{"$defs":{"Part":{"additionalProperties":false,"type":"object"}},"additionalProperties":false,"properties":{"child":' AS head, ',"findings":{"items":[{"additionalProperties":false,"type":"object"},' || (d + 1) || ',null,"object"],' AS list, '"type":"array"}},"title":"T' || (d + 1) || '","type":"object"}' AS tail FROM e WHERE d < 5))
    SELECT conv_id, turn, md5(root) AS schema_md5 FROM conversations LEFT JOIN e ON e.d = (conv_id + turn) % 7
""")
def strict_schemas(table):
    """Schemas of up to 6 objects in one another, and some text that is none, made strict."""
    depth = (F.col("conv_id") + F.col("turn")) % 7

    def deeper(inner, d):
        parts = F.lit('{"type": "object", "title": "T'), d.cast("string"), F.lit('", "properties": {"findings": {"type": "array", "items": [{"type": "object", "additionalProperties": true}, '), d.cast("string"), F.lit(', null, "object"]}, "child": '), inner, F.lit('}, "$defs": {"Part": {"type": "object"}}}')
        return F.concat(*parts)

    nested = F.aggregate(F.when(depth > 0, F.sequence(F.lit(1).cast("long"), depth)).otherwise(F.expr("cast(array() as array<bigint>)")), F.lit('{"type": "object", "properties": {}}'), deeper)
    schemas = table("conversations").select(F.struct("conv_id", "turn").alias("key"), F.when(depth == 6, "{no schema").otherwise(nested).alias("schema"))
    return messages.strict(schemas, "key", "schema", "findings").select("key.*", F.md5(F.col("schema").cast("binary")).alias("schema_md5"))


@query()
def vocabulary_token_count(table):
    """Counts by a public vocabulary; no SQL says that, tests hold it against the tokenizers library."""
    return table("documents").select("doc_id", text.exact_tokens(text.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))(F.col("text")).alias("n_tokens"))
