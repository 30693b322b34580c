"""Tool-call linking, with DataFrame functions only: calls and results are hash-joined by identifier, ordered topologically by the
results that arguments refer to, validated against schemas and serialised as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import written

# Tool: parameter: (type, required). Types are those of JSON: string, integer, number, boolean, object, array.
Schemas = dict[str, dict[str, tuple[str, bool]]]
REPLY: Schemas = {"reply": {"context": ("string", False), "prompt": ("string", True), "turn": ("integer", True)}}
REFERENCE = r"\$ref:([A-Za-z0-9_.:-]+)"
_MESSAGE = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,content:string>"
_JSON_TYPES = {
    "string": "^STRING$", "integer": "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\\([0-9]+,0\\))$", "number": "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|FLOAT|DOUBLE)$",
    "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY",
}


def _turn_id(turn: Column) -> Column:
    return F.concat(F.lit("turn-"), turn.cast("string"))


def messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, index, call_id, name, arguments) and results (conv_id, turn, call_id, content) of ``conversations``.

    A turn whose text is a JSON object with tool_calls makes these calls, one with tool_call_id is that call's result. Any other
    user turn is a call of the tool reply, named by its turn, with the conversation's first user turn as context; an assistant
    turn is the result of the turn before it, and any other tool turn a result without identifier. System turns, turns of another
    role and turns without a number are neither.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).where("turn IS NOT NULL")
    parsed = rows.withColumn("message", F.when(F.ltrim("text").startswith("{"), F.from_json("text", _MESSAGE)))
    has_calls = F.coalesce(F.size("message.tool_calls") > 0, F.lit(False))
    is_result = F.coalesce(F.col("message.tool_call_id").isNotNull(), F.lit(False)) & ~has_calls
    marked = parsed.select("*", has_calls.alias("calling"), is_result.alias("answering"))
    stated = marked.where("calling").select("conv_id", "turn", F.posexplode("message.tool_calls").alias("index", "call")).select(
        "conv_id", "turn", F.col("index").cast("bigint"), F.col("call.id").alias("call_id"), "call.name", "call.arguments"
    )
    asked = marked.where("NOT calling AND NOT answering AND role = 'user'")
    first = asked.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "c")
    met = asked.join(first, F.col("conv_id").eqNullSafe(F.col("c")))
    context = F.when(F.col("turn") > F.col("first"), F.concat(F.lit("$ref:"), _turn_id(F.col("first"))))
    told = met.select(
        "conv_id", "turn", F.lit(0).cast("bigint").alias("index"), _turn_id(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(context.alias("context"), F.col("text").alias("prompt"), "turn")).alias("arguments"),
    )
    given = marked.where("answering").select("conv_id", "turn", F.col("message.tool_call_id").alias("call_id"), F.coalesce("message.content", F.lit("")).alias("content"))
    said = marked.where("NOT calling AND NOT answering AND role = 'assistant'").select(
        "conv_id", "turn", _turn_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    stray = marked.where("NOT calling AND NOT answering AND role = 'tool'").select(
        "conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.col("text").alias("content")
    )
    return stated.union(told), given.union(said).union(stray)


def _problems(schemas: Schemas) -> Column:
    """What is wrong with the arguments (variant column ``given``, text ``arguments``) of the tool ``name``."""
    found = F.when(F.col("name").isNull() | ~F.col("name").isin(list(schemas)), F.array(F.lit("unknown_tool")))
    for tool, parameters in sorted(schemas.items()):
        checks = []
        for parameter, (kind, required) in sorted(parameters.items()):
            actual = F.schema_of_variant(F.try_variant_get("given", f"$['{parameter}']", "variant"))
            absent = actual.isNull() | (actual == "VOID")
            if required:
                checks.append(F.when(absent, F.lit(f"missing:{parameter}")))
            checks.append(F.when(~absent & ~actual.rlike(_JSON_TYPES[kind]), F.lit(f"type:{parameter}")))
        extra = F.transform(
            F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")), F.array(*map(F.lit, parameters))),
            lambda key: F.concat(F.lit("unexpected:"), key),
        )
        found = found.when(F.col("name") == tool, F.array_compact(F.concat(F.array(*checks), extra)))
    return F.when(F.col("given").isNull() | ~F.schema_of_variant("given").startswith("OBJECT"), F.array(F.lit("not_an_object"))).otherwise(found)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, dangling) for each identifier: 0 without references, else one more than the highest it refers to.

    Each round settles the calls whose references are all settled, so there are as many rounds as the longest chain of
    references is long. Calls on a cycle, and those that wait for them, have a null level. Identifiers are told apart by conversation.
    """
    nodes = written(calls.select("conv_id", "call_id", F.expr(f"regexp_extract_all(arguments, r'{REFERENCE}', 1)").alias("refs")).distinct())
    names = nodes.select(F.col("conv_id").alias("c"), F.col("call_id").alias("ref")).distinct().withColumn("there", F.lit(True))
    edges = nodes.select("conv_id", "call_id", F.explode("refs").alias("r")).distinct()
    edges = edges.join(names, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("r") == F.col("ref")), "left").select("conv_id", "call_id", "r", F.coalesce("there", F.lit(False)).alias("there"))
    edges = written(edges)
    ids = nodes.select("conv_id", "call_id").distinct()
    waiting = edges.where("there").select("conv_id", "call_id", "r")

    def apart(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("i2"), *[x for x in right.columns if x not in ("conv_id", "call_id")])
        return left.join(other, F.col("conv_id").eqNullSafe(F.col("c2")) & F.col("call_id").eqNullSafe(F.col("i2")), how).drop("c2", "i2")

    settled = written(apart(ids, waiting.select("conv_id", "call_id").distinct(), "left_anti").withColumn("level", F.lit(0).cast("bigint")))
    while not waiting.isEmpty():
        done = settled.select(F.col("conv_id").alias("c3"), F.col("call_id").alias("i3"), "level")
        seen = waiting.join(done, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("r") == F.col("i3")), "left")
        ready = written(seen.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("known"), (F.max("level") + 1).alias("level")).where("n = known"))
        if ready.isEmpty():
            break
        settled = written(settled.union(ready.select("conv_id", "call_id", "level")))
        waiting = written(apart(waiting, ready.select("conv_id", "call_id"), "left_anti"))
    dangling = edges.where("NOT there").select("conv_id", "call_id").distinct().withColumn("dangling", F.lit(True))
    return apart(apart(ids, settled, "left"), dangling, "left").withColumn("dangling", F.coalesce("dangling", F.lit(False)))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, call_id, level, turn, index, name, status, errors, n_results, json): one row per call, and per result that isn't linked.

    ``level``, ``turn`` and ``index`` sort a conversation's calls topologically. The first result by turn (then by text) is linked, each
    further one is a row of its own (extra_result), as is each result without a call (orphan_result). ``n_results`` counts the results of
    the identifier. ``status`` of a call is ok, or the first of: cyclic, duplicate_id, dangling_reference, invalid_arguments, no_result; ``errors`` are the
    faults of the arguments. ``json`` has its keys in order and no white space, arguments too; arguments that are no JSON stay text.
    Null and empty arguments are no object; a null identifier is never linked; repeated rows are duplicates; tables without rows
    give no rows.
    """
    # A number tells repeated results apart; it is written, so that it stays the same.
    results = written(results.withColumn("number", F.monotonically_increasing_id()))
    firsts = written(
        results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content", "number")).alias("first"), F.count(F.lit(1)).alias("n_results"))
    ).select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "first", "n_results")
    order = levels(calls).select(F.col("conv_id").alias("oc"), F.col("call_id").alias("oi"), "level", "dangling")
    same = calls.groupBy(F.col("conv_id").alias("sc"), F.col("call_id").alias("si")).agg(F.count(F.lit(1)).alias("n_same"))
    joined = (
        calls.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left")
        .join(order, F.col("conv_id").eqNullSafe(F.col("oc")) & F.col("call_id").eqNullSafe(F.col("oi")), "left")
        .join(same, F.col("conv_id").eqNullSafe(F.col("sc")) & F.col("call_id").eqNullSafe(F.col("si")), "left")
    )
    judged = joined.withColumn("given", F.try_parse_json("arguments")).withColumn("errors", _problems(schemas))
    status = (
        F.when(F.col("level").isNull(), "cyclic").when(F.col("n_same") > 1, "duplicate_id").when(F.col("dangling"), "dangling_reference")
        .when(F.size("errors") > 0, "invalid_arguments").when(F.col("first").isNull(), "no_result").otherwise("ok")
    )
    linked = judged.select(
        "conv_id", "call_id", "level", "turn", "index", "name", status.alias("status"), "errors", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "arguments", "given", "first",
    )
    known = calls.select(F.col("conv_id").alias("kc"), F.col("call_id").alias("ki")).distinct()
    told = firsts.join(known.withColumn("called", F.lit(True)), F.col("c").eqNullSafe(F.col("kc")) & (F.col("i") == F.col("ki")), "left")
    each = results.join(told, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("call_id").eqNullSafe(F.col("i")))
    unlinked = each.where(F.col("called").isNull() | (F.col("number") != F.col("first.number"))).select(
        "conv_id", "call_id", F.lit(None).cast("bigint").alias("level"), "turn", F.lit(0).cast("bigint").alias("index"), F.lit(None).cast("string").alias("name"),
        F.when(F.col("called"), "extra_result").otherwise("orphan_result").alias("status"), F.array().cast("array<string>").alias("errors"), "n_results",
        F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("variant").alias("given"), F.struct("turn", "content", "number").alias("first"),
    )
    def plain(column: Column) -> Column:
        """One value as JSON: what stands between {"v": and }."""
        text = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
        return F.substring(text, F.lit(6), F.length(text) - 6)

    arguments = F.when(F.col("given").isNull(), plain(F.col("arguments"))).otherwise(F.to_json("given"))
    json = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"call_id":'), plain(F.col("call_id")), F.lit(',"conv_id":'), plain(F.col("conv_id")), F.lit(',"errors":'),
        plain(F.col("errors")), F.lit(',"level":'), plain(F.col("level")), F.lit(',"name":'), plain(F.col("name")), F.lit(',"result":'), plain(F.col("first.content")),
        F.lit(',"status":'), plain(F.col("status")), F.lit(',"turn":'), plain(F.col("turn")), F.lit("}"),
    )
    return linked.union(unlinked).select("conv_id", "call_id", "level", "turn", "index", "name", "status", "errors", "n_results", json.alias("json"))


def link_conversations(conversations: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """Calls and results of ``conversations`` (conv_id, turn, role, text), linked; cases as in ``messages`` and ``link_calls``."""
    calls, results = messages(conversations)
    return link_calls(written(calls), results, REPLY | (schemas or {}))
