"""Chat formatting: tool calls are linked to their results, put in topological order, validated and serialised.

Only DataFrame functions are used.  Calls and results are joined by conversation and identifier (a shuffled hash join; of several results of a call the
earliest counts).  The level of a call is the length of the longest chain of calls it depends on.  Levels are found by policy iteration: each call picks one of the
calls it needs, the chains so formed are measured by pointer doubling in about log2 of their length of rounds, and calls whose pick isn't the deepest
of their needs pick again, until none does.  The first pick is the need of the latest turn, which is mostly right.
Arguments are parsed as JSON objects and checked against schemas (field, type, required), those given and those that a conversation declares; records are canonical
JSON: keys sorted, no blanks.

Defined cases: the record of a call without result has no ``result``; results without call are left out; a call whose arguments are no
JSON object, or whose name has no schema, is invalid; a dependency on an unknown call of the conversation is ignored; calls on or behind a cycle have a null level;
repeated calls each keep their row; identifiers count within their conversation, and a null identifier or conversation links to nothing and has a null level; empty tables
give an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, fresh

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
#: The name and fields of the call that an ordinary exchange stands for: (field, types, required).
REPLY = ("reply", [("chars", ["BIGINT"], True), ("turn", ["BIGINT"], True)])


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no blanks; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(json))


def messages_to_calls(messages: DataFrame) -> DataFrame:
    """Calls of a table (conv_id, turn, role, text).

    An assistant's text that is a JSON object with ``tool_calls`` [{id, name, arguments, depends_on}] gives those calls.
    Any user turn is a call ``reply`` with the identifier conv_id:turn that depends on the user turn before it.
    """
    calls = F.from_json(F.get_json_object("text", "$.tool_calls"), "array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>")
    asked = messages.where("role = 'assistant' and startswith(ltrim(text), '{')").select("conv_id", "turn", F.explode(calls).alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    plain = messages.where("role = 'user'").select(
        "conv_id",
        "turn",
        F.when(known, name(F.col("turn"))).alias("call_id"),
        F.lit(REPLY[0]).alias("name"),
        F.to_json(F.struct(F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"))).alias("arguments"),
        F.when(known, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    return plain.unionByName(asked)


def messages_to_results(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, result_turn, result): tool messages by their tool_call_id, and an assistant turn for the user turn just before it."""
    tool = messages.where("role = 'tool'").select("conv_id", F.get_json_object("text", "$.tool_call_id").alias("call_id"), F.col("turn").alias("result_turn"), F.get_json_object("text", "$.content").alias("result"))
    plain = messages.where("role = 'assistant' and conv_id is not null and turn is not null").select("conv_id", F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("result_turn"), F.coalesce("text", F.lit("")).alias("result"))
    return plain.unionByName(tool)


def messages_to_schemas(messages: DataFrame) -> DataFrame:
    """(conv_id, name, types, required): the functions that a conversation's system messages declare ({"tools": [{"function": {name, parameters}}]}).

    types: field -> JSON schema type.  Of several declarations of a name the earliest counts.
    """
    shape = "array<struct<function:struct<name:string,parameters:struct<properties:map<string,struct<type:string>>,required:array<string>>>>>"
    tools = messages.where("role = 'system' and conv_id is not null and startswith(ltrim(text), '{')").select("conv_id", "turn", F.explode(F.from_json(F.get_json_object("text", "$.tools"), shape)).alias("t"))
    f = F.col("t.function")
    types = F.to_json(F.transform_values(f["parameters"]["properties"], lambda _, v: v["type"]))  # maps have no order to take the least by
    one = tools.select("conv_id", f["name"].alias("name"), F.struct("turn", types.alias("types"), f["parameters"]["required"].alias("required")).alias("d")).where("name is not null").groupBy("conv_id", "name").agg(F.min("d").alias("d"))
    return one.select("conv_id", "name", F.coalesce(F.from_json("d.types", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("types"), F.coalesce("d.required", F.array().cast("array<string>")).alias("required"))


def _measured(policy: DataFrame) -> DataFrame:
    """(call_id, level) along the picks (call_id, to): 0 without one; null on or behind a cycle of picks.

    Each round a call takes over its target's pointer, so pointers double their reach.  As long as a call outside cycles is open, some
    pointer rests on a settled call, and every round settles some; the first round that settles none is the last.
    """
    state = cut(policy.select("call_id", F.when(F.col("to").isNull(), 0).alias("level"), "to", F.when(F.col("to").isNotNull(), 1).alias("off")), "levels")
    open_ = state.where("level is null").count()
    while open_:
        target = state.select(F.col("call_id").alias("to"), F.col("level").alias("l"), F.col("to").alias("next"), F.col("off").alias("more"))
        # Settled calls need no join; they point nowhere any more.
        joined = state.where("level is null").join(target, "to", "left")
        settled = F.when(F.col("l").isNotNull(), F.col("l") + F.col("off"))
        jump = F.col("next").isNotNull() & F.col("l").isNull()
        new = joined.select("call_id", settled.alias("level"), F.when(settled.isNull(), F.when(jump, F.col("next")).otherwise(F.col("to"))).alias("to"), (F.col("off") + F.when(jump, F.col("more")).otherwise(0)).alias("off"))
        state = cut(state.where("level is not null").unionByName(new), "levels")
        left = state.where("level is null").count()
        if left == open_:
            break
        open_ = left
    return state.select("call_id", "level")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 without dependencies, else one more than the highest among them; null on or behind a cycle.

    calls: call_id, depends_on and, if there is one, turn.  A pick is only changed for a strictly deeper need (a cycle counts as deepest), so levels along the picks never fall and
    the rounds end; without several needs a call there is one round.
    """
    known = calls.where("call_id is not null").withColumn("turn", F.col("turn") if "turn" in calls.columns else F.lit(0))
    nodes = cut(known.groupBy("call_id").agg(F.max("turn").alias("turn")), "calls")
    needs = known.select("call_id", F.explode("depends_on").alias("need")).where("need is not null").distinct()
    edges = cut(needs.join(nodes.withColumnRenamed("call_id", "need"), "need").select("call_id", "need", "turn"), "needs")
    # Calls with one need have no choice.
    waits = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.max(F.struct("turn", "need"))["need"].alias("to"))
    policy = cut(nodes.select("call_id").join(waits, "call_id", "left"), "picks")
    several = cut(edges.join(policy.where("n > 1").select("call_id"), "call_id").select("call_id", "need"), "several")
    any_several = not several.isEmpty()
    while True:
        found = cut(_measured(policy), "measured") if any_several else _measured(policy)
        if not any_several:
            return found
        depth = F.coalesce("level", F.lit(1 << 30))
        best = several.join(found.select(F.col("call_id").alias("need"), depth.alias("depth")), "need").groupBy("call_id").agg(F.max(F.struct("depth", "need")).alias("best"))
        picked = best.join(policy.select("call_id", "to"), "call_id").join(found.select(F.col("call_id").alias("to"), depth.alias("own")), "to")
        change = cut(picked.where("best.depth > own").select("call_id", F.col("best.need").alias("new")), "changes")
        if change.isEmpty():
            return found
        policy = cut(policy.join(change, "call_id", "left").select("call_id", "n", F.coalesce("new", "to").alias("to")), "picks")


#: JSON schema types and the beginnings of the names that values of them have.
KINDS = {"integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE", "string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def validated(calls: DataFrame, schemas: list[tuple[str, list[tuple[str, list[str], bool]]]], declared: DataFrame | None = None) -> DataFrame:
    """``calls`` with ``valid``: the arguments are an object, each required field is there, and each known field has one of its types.

    A given schema goes before one that the conversation declares.
    """
    kinds_, types_, required_ = (fresh(calls, f"_{x}") for x in ("kinds", "types", "required"))
    kinds = F.transform_values(F.from_json("arguments", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    df = calls.withColumn(kinds_, F.when(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), kinds))
    ok = F.lit(False)
    if declared is not None:
        df = df.join(declared.select("conv_id", "name", F.col("types").alias(types_), F.col("required").alias(required_)), ["conv_id", "name"], "left")
        known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
        right = lambda field, type_: F.try_element_at(kinds_, field).isNull() | F.coalesce(F.rlike(F.try_element_at(kinds_, field), F.concat(F.lit("^("), F.try_element_at(known, type_), F.lit(")"))), F.lit(True))
        ok = F.forall(required_, lambda f: F.map_contains_key(kinds_, f)) & F.forall(F.map_entries(types_), lambda e: right(e["key"], e["value"]))
    for name, fields in schemas:
        checks = F.col(kinds_).isNotNull()
        for field, allowed, required in fields:
            kind = F.try_element_at(kinds_, F.lit(field))
            checks = checks & (F.coalesce(kind.isin(allowed), F.lit(False)) if required else (kind.isNull() | kind.isin(allowed)))
        ok = F.when(F.col("name") == name, checks).otherwise(ok)
    return df.withColumn("valid", F.coalesce(ok, F.lit(False))).drop(kinds_, types_, required_)


def link(calls: DataFrame, results: DataFrame, schemas, declared: DataFrame | None = None) -> DataFrame:
    """One row a call: conv_id, turn, call_id, name, level, valid, linked, result_turn, record."""
    both = ["conv_id", "call_id"]
    one = results.where("call_id is not null and conv_id is not null").groupBy(*both).agg(F.min(F.struct("result_turn", "result")).alias("r"))
    name = lambda call: F.concat(F.col("conv_id").cast("string"), F.lit("\u001f"), call)
    named = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on", name(F.col("call_id")).alias("_call"))
    ordered = levels(named.select(F.col("_call").alias("call_id"), F.transform("depends_on", name).alias("depends_on"), "turn")).withColumnRenamed("call_id", "_call")
    joined = validated(named, schemas, declared).join(one.hint("shuffle_hash"), both, "left").join(ordered, "_call", "left")
    record = F.struct(
        F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw")))).alias("arguments"),
        F.col("call_id"),
        F.col("name"),
        F.col("r.result").alias("result"),
    )
    return joined.select("conv_id", "turn", "call_id", "name", "level", "valid", F.col("r").isNotNull().alias("linked"), F.col("r.result_turn").alias("result_turn"), F.to_json(record).alias("record"))
