"""Messages with tool calls in the two forms that providers take, and JSON schemas made strict.

The block form: a message has a role and either a text or blocks, each a text, a tool_use (id, name, input) or a tool_result (tool_use_id, content). The chat
form: a flat list of messages with content, tool_calls and tool_call_id. Inputs are JSON texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.tables import stored

BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>"
MESSAGE = f"struct<role:string,text:string,blocks:array<{BLOCK}>>"
CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
CHAT = f"struct<role:string,content:string,tool_calls:array<{CALL}>,tool_call_id:string>"


def _chat(role: Column | str, content: Column | None = None, calls: Column | None = None, of: Column | None = None) -> Column:
    own = [F.lit(role) if isinstance(role, str) else role, content, calls, of]
    return F.struct(*[(F.lit(None) if c is None else c).alias(n) for c, n in zip(own, ("role", "content", "tool_calls", "tool_call_id"), strict=True)]).cast(CHAT)


def _block(**values: Column) -> Column:
    names = ("type", "text", "id", "name", "input", "tool_use_id", "content")
    return F.struct(*[values.get(n, F.lit(None)).alias(n) for n in names]).cast(BLOCK)


def to_chat(messages: Column, system: Column) -> Column:
    """The chat form of an array of messages in the block form, after a system message. A block of another type is an error: none is ever left out."""

    def of_block(role: Column, b: Column) -> Column:
        call = F.struct(b["id"].alias("id"), F.lit("function").alias("type"), F.struct(b["name"].alias("name"), b["input"].alias("arguments")).alias("function"))
        unknown = F.raise_error(F.concat(F.lit("unknown type of block: "), F.coalesce(b["type"], F.lit("null")))).cast(CHAT)
        return (
            F.when(b["type"] == "tool_use", _chat("assistant", calls=F.array(call)))
            .when(b["type"] == "tool_result", _chat("tool", b["content"], of=b["tool_use_id"]))
            .when(b["type"] == "text", _chat(role, b["text"]))
            .otherwise(unknown)
        )

    each = F.transform(messages, lambda m: F.when(m["text"].isNotNull(), F.array(_chat(m["role"], m["text"]))).otherwise(F.transform(m["blocks"], lambda b: of_block(m["role"], b))))
    return F.concat(F.array(_chat("system", system)), F.flatten(each))


def from_chat(chat: Column) -> Column:
    """The block form of messages in the chat form, without the system message at their head: one message for each, a call or a result as a block."""

    def of(c: Column) -> Column:
        calls = F.transform(c["tool_calls"], lambda x: _block(type=F.lit("tool_use"), id=x["id"], name=x["function"]["name"], input=x["function"]["arguments"]))
        result = F.array(_block(type=F.lit("tool_result"), tool_use_id=c["tool_call_id"], content=c["content"]))
        blocks = F.when(F.size(c["tool_calls"]) > 0, calls).when(c["role"] == "tool", result)
        role = F.when(c["role"] == "tool", "user").otherwise(c["role"])
        return F.struct(role.alias("role"), F.when(blocks.isNull(), c["content"]).alias("text"), blocks.alias("blocks")).cast(MESSAGE)

    return F.transform(F.filter(chat, lambda c, i: (i > 0) | (c["role"] != "system")), of)


def apart(messages: Column) -> Column:
    """Messages with a block each, and texts in place of text blocks: what from_chat gives for to_chat's."""

    def of(m: Column) -> Column:
        one = lambda b: F.struct(F.when(b["type"] == "tool_use", "assistant").when(b["type"] == "tool_result", "user").otherwise(m["role"]).alias("role"), F.when(b["type"] == "text", b["text"]).alias("text"), F.when(b["type"] != "text", F.array(b)).alias("blocks")).cast(MESSAGE)
        return F.when(m["text"].isNotNull(), F.array(m)).otherwise(F.transform(m["blocks"], one))

    return F.flatten(F.transform(messages, of))


def tool_pairs(messages: Column) -> Column:
    """Each tool call of an array of messages in order with its result: id, name, content (null without one)."""
    blocks = lambda kind: F.filter(F.flatten(F.transform(messages, lambda m: F.coalesce(m["blocks"], F.array().cast(f"array<{BLOCK}>")))), lambda b: b["type"] == kind)
    results = blocks("tool_result")
    return F.transform(blocks("tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), F.get(F.filter(results, lambda r: r["tool_use_id"] == b["id"]), 0)["content"].alias("content")))


def tools(specs: Column) -> Column:
    """Function tools of an array of specs (name, description or null, input_schema)."""
    return F.transform(specs, lambda s: F.struct(F.lit("function").alias("type"), F.struct(s["name"].alias("name"), F.coalesce(s["description"], F.lit("")).alias("description"), s["input_schema"].alias("parameters")).alias("function")))


def tool_choice(choice: Column) -> Column:
    """A choice (type, name) for the chat form as JSON text: a named tool as a function; others as they are."""
    named = F.to_json(F.struct(F.lit("function").alias("type"), F.struct(choice["name"].alias("name")).alias("function")))
    return F.when((choice["type"] == "tool") & choice["name"].isNotNull(), named).otherwise(F.to_json(choice))


def _other_than(name: str):
    return lambda part: part["name"] != name


def _quoted(name: Column) -> Column:
    """A key as JSON."""
    listed = F.to_json(F.array(name))
    return listed.substr(F.lit(2), F.length(listed) - 2)


_STEP = "struct<container:string,pos:int,name:string>"


def strict(schemas: DataFrame, key: str, schema: str, at_least_one: str | None = None) -> DataFrame:
    """key and the schema as JSON text, its objects' keys in order, in which each subschema of type object says additionalProperties false, and the root's
    property at_least_one, if it is an object, minItems 1. Text that isn't JSON gives null. Keys must be distinct.

    Depth isn't bounded: each round opens the objects and arrays of one level into rows, until none is left, and then each level is put together
    from the one below. A level is a grouping by schema and path, so that a large schema is spread over tasks.
    """
    whole = schemas.select(F.col(key).alias("k"), F.try_parse_json(schema).alias("v"), F.array().cast(f"array<{_STEP}>").alias("path"))
    broken = whole.where("v is null").select(F.col("k").alias(key), F.lit(None).cast("string").alias(schema))
    kind = F.schema_of_variant("v")
    container = F.when(kind.startswith("OBJECT"), "o").when(kind.startswith("ARRAY"), "a")
    # scalars and empty containers are text at once
    done, level, depth = [], whole.where("v is not null"), 0
    while True:
        own = level.withColumn("container", container).withColumn("text", F.to_json("v"))
        opened = stored(own.withColumn("closed", F.col("container").isNull() | F.col("text").isin("{}", "[]")), f"level-{depth}")
        closed = opened.where("closed").select("k", "path", "text")
        if at_least_one:  # also where the property is an empty object
            wanted = (F.transform("path", lambda s: s["name"]) == F.array(F.lit("properties"), F.lit(at_least_one))) & (F.col("text") == "{}")
            closed = closed.withColumn("text", F.when(wanted, '{"minItems":1}').otherwise(F.col("text")))
        done.append(closed)
        inner = opened.where("not closed")
        if inner.isEmpty():
            break
        spark = schemas.sparkSession
        children = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "child"))
        step = F.struct(F.col("container"), F.col("pos").cast("int").alias("pos"), F.coalesce("name", F.lit("")).alias("name")).cast(_STEP)
        level, depth = children.select("k", F.col("child").alias("v"), F.concat("path", F.array(step)).alias("path")), depth + 1
    up = done[depth]
    for at in range(depth - 1, -1, -1):
        last = F.element_at("path", -1)
        parent = F.slice("path", F.lit(1), F.size("path") - 1)
        parts = up.select("k", parent.alias("path"), last["container"].alias("container"), last["pos"].alias("pos"), last["name"].alias("name"), "text")
        met = parts.groupBy("k", "path", "container").agg(F.collect_list(F.struct("name", "pos", "text")).alias("parts"))
        has_type = F.exists("parts", lambda p: (p["name"] == "type") & (p["text"] == '"object"'))
        at_root = F.transform("path", lambda s: s["name"])
        add = {"additionalProperties": ("false", has_type)}
        if at_least_one:
            add["minItems"] = ("1", at_root == F.array(F.lit("properties"), F.lit(at_least_one)))
        fields = F.col("parts")
        for name, (value, when) in add.items():
            new = F.array(F.struct(F.lit(name).alias("name"), F.lit(0).alias("pos"), F.lit(value).alias("text")))
            fields = F.when(when, F.concat(F.filter(fields, _other_than(name)), new)).otherwise(fields)
        as_object = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(fields), lambda p: F.concat(_quoted(p["name"]), F.lit(":"), p["text"])), ","), F.lit("}"))
        as_array = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.transform("parts", lambda p: F.struct(p["pos"], p["text"]))), lambda p: p["text"]), ","), F.lit("]"))
        made = met.select("k", "path", F.when(F.col("container") == "o", as_object).otherwise(as_array).alias("text"))
        up = made.unionByName(done[at])
    return up.select(F.col("k").alias(key), F.col("text").alias(schema)).unionByName(broken)
