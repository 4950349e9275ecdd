"""Tool-call linking for chat data, with DataFrame functions only.

Calls and results meet in a hash join on the call's identifier. A call may come ``after`` another one whose result it
uses; its level in that order is found by pointer doubling, so a chain of n calls takes about log2(n) joins of slim rows
and a conversation of any length never has to fit into one task. Arguments are held against tool schemas by the JSON type
of each value, and every linked call is serialised as canonical JSON (sorted keys, no blanks, no null fields).

Edge cases, by ``status``: ``no_id`` for calls without an identifier; ``unknown_tool`` for names without a schema;
``bad_arguments`` for text that is not a JSON object, repeats a key, lacks a required argument or has one of another type;
``cycle`` for calls that wait for themselves (their level is null); ``missing_result`` for calls without a result; else
``ok``. The first that holds counts. References to calls that do not exist are no dependency. Repeated calls or results
with the same identifier count once, the smallest in (conversation, turn, content). Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: JSON schema type to the types that Spark's variants report for it.
TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\([0-9]+,0\)", "number": r"BIGINT|DECIMAL\(.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id, after): 0 without a dependency, else one more than that call's; null in cycles.

    Every open call points at an ancestor and knows the distance; each round replaces the pointer by the ancestor's own. A
    call without a pointer is done and is not written again. Round r ends the calls of 2^(r-1) to 2^r - 1 levels, and levels
    have no gaps, so after a round that ends none the rest hangs on cycles.
    """
    ids = calls.select(F.col("call_id").alias("at"))
    start = calls.join(ids.hint("shuffle_hash"), calls["after"] == ids["at"], "left").select("call_id", "at", F.when(F.col("at").isNull(), 0).otherwise(1).alias("steps"))
    start = materialize(start, "call-levels")
    done, open_ = start.where("at is null"), start.where("at is not null")
    left = open_.count()
    while left:
        up = done.unionByName(open_).select(F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
        moved = open_.join(up.hint("shuffle_hash"), "at").select("call_id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"))
        moved = materialize(moved, "call-levels")
        done, open_ = done.unionByName(moved.where("at is null")), moved.where("at is not null")
        before, left = left, open_.count()
        if left == before:
            break
    return done.select("call_id", F.col("steps").cast("long").alias("level")).unionByName(open_.select("call_id", F.lit(None).cast("long").alias("level")))


def _valid(types: Column, parameters: Column) -> Column:
    """Whether a map of argument to type suits an array of (param, type, required)."""
    def one(p: Column) -> Column:
        got = F.element_at(types, p["param"])
        fits = F.lit(False)
        for name, pattern in TYPES.items():
            fits = F.when(p["type"] == name, got.rlike(f"^(?:{pattern})$")).otherwise(fits)
        return F.when(got.isNull(), ~p["required"]).otherwise(fits)

    return types.isNotNull() & F.forall(parameters, one)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each call with its level, status, result and canonical message.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (call_id or null); results: call_id, turn, content;
    schemas: name, param, type (of JSON schema), required.
    """
    given = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    once = given.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("conv_id", "turn", "name", "arguments", "after")).alias("c")).select("call_id", "c.*")
    once = materialize(once, "calls")
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("r")).select("call_id", F.col("r.content").alias("result"), F.lit(True).alias("answered"))
    tools = schemas.groupBy("name").agg(F.collect_set(F.struct("param", "type", "required")).alias("parameters"))
    linked = once.join(levels(once).hint("shuffle_hash"), "call_id").join(answers.hint("shuffle_hash"), "call_id", "left")
    linked = linked.unionByName(given.where("call_id is null"), allowMissingColumns=True).join(tools, "name", "left")
    parsed = linked.withColumn("json", F.try_parse_json("arguments"))
    types = F.transform_values(F.try_variant_get("json", "$", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    status = (F.when(F.col("call_id").isNull(), "no_id").when(F.col("parameters").isNull(), "unknown_tool")
              .when(~F.coalesce(_valid(types, F.col("parameters")), F.lit(False)), "bad_arguments").when(F.col("level").isNull(), "cycle")
              .when(F.col("answered").isNull(), "missing_result").otherwise("ok"))
    message = F.to_json(F.struct(F.col("json").alias("arguments"), "call_id", "level", "name", "result", F.col("status")))
    return parsed.withColumn("status", status).select("conv_id", "turn", "call_id", "name", "level", "status", message.alias("message"))


# The tools that calls derived from plain conversations use.
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", True), ("lookup", "query", "string", True), ("lookup", "limit", "integer", False), ("note", "query", "string", True)]


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain conversations: an assistant's turn calls a tool with its first word and its length,
    the user's turn that follows is the result, and the assistant's turn before, if any, comes first."""
    def call_id(turn: Column) -> Column:
        return F.concat_ws("_", F.lit("call"), "conv_id", turn)

    asked = conversations.where("role = 'assistant' and conv_id is not null and turn is not null")
    n = F.char_length(F.coalesce("text", F.lit("")))
    query = F.to_json(F.struct(F.regexp_extract(F.coalesce("text", F.lit("")), r"[^\x20\x09-\x0D]+", 0).alias("query")))
    limit = F.when(n % 7 == 3, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string"))
    name = F.element_at(F.array(*map(F.lit, ("search", "lookup", "note", "other"))), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)).cast("int") + 1)
    arguments = F.concat(F.substring(query, F.lit(1), F.char_length(query) - 1), F.lit(', "limit": '), limit, F.lit("}"))
    calls = asked.select("conv_id", "turn", call_id(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), call_id(F.col("turn") - 2).alias("after"))
    said = conversations.where("role = 'user' and conv_id is not null and turn is not null")
    return calls, said.select(call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
