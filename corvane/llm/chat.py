"""Chat formatting by tool-call linking, with DataFrame functions only.

A turn is plain text, or a JSON object.  An object with ``tool_calls`` (each with ``id``, ``name`` or ``function.name``, and
``arguments``, an object or its JSON text) makes a message and its calls; an object with
``tool_call_id`` is the result of a call.  Calls and results meet in a hash join on conversation and
identifier, so a conversation of any length is spread over its identifiers.  An argument
``{"$result": "id"}`` makes a call depend on another call's result.  Order keys put every result after its
call and every call after the results that it needs; otherwise turns keep their order.  Arguments are
checked against the tools' schemas.  Each message, call and result becomes one line of canonical JSON:
keys sorted, no blanks.

Rows are never gathered by conversation; ``ORDER`` sorts them when they are written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import Scratch

#: Columns that order the lines of a conversation.
ORDER = ("at", "level", "turn", "idx", "step")

#: JSON Schema types and the variant types that satisfy them.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*|STRUCT.*|MAP.*"}

def _lines(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A row for each message, call and result, with what the text says of it."""
    t = F.col(text).cast("string")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), t.alias("text"))
    rows = rows.withColumn("v", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    rows = rows.withColumns({"calls": F.try_variant_get("v", "$.tool_calls", "array<variant>"), "of": F.try_variant_get("v", "$.tool_call_id", "string")})
    none = {"call_id": F.lit(None).cast("string"), "tool": F.lit(None).cast("string"), "args": F.lit(None).cast("string")}
    content = F.when(F.col("calls").isNull() & F.col("of").isNull(), F.col("text")).otherwise(F.try_variant_get("v", "$.content", "string"))
    own = rows.select("conv", "turn", F.lit(0).alias("idx"), F.when(F.col("of").isNull(), "message").otherwise("result").alias("kind"), "role", content.alias("content"), F.col("of").alias("call_id"), none["tool"].alias("tool"), none["args"].alias("args"))
    each = rows.filter("size(calls) > 0").select("conv", "turn", "role", F.posexplode("calls").alias("k", "c"))
    raw = F.coalesce(F.try_variant_get("c", "$.arguments", "string"), F.try_variant_get("c", "$.function.arguments", "string"))
    called = each.select(
        "conv",
        "turn",
        (F.col("k") + 1).alias("idx"),
        F.lit("call").alias("kind"),
        "role",
        F.lit(None).cast("string").alias("content"),
        F.try_variant_get("c", "$.id", "string").alias("call_id"),
        F.coalesce(F.try_variant_get("c", "$.name", "string"), F.try_variant_get("c", "$.function.name", "string")).alias("tool"),
        raw.alias("args"),
    )
    return own.unionByName(called)


def _problems(args: Column, known: Column, params: Column) -> Column:
    """What is wrong with the arguments: no object, an unknown tool, or parameters that are missing, of another type or not in the schema."""
    values = F.from_json(args, "map<string,variant>")
    kind = F.expr("transform_values(from_json(args, 'map<string,variant>'), (k, x) -> schema_of_variant(x))")

    def wrong(p: Column) -> Column:
        got = F.try_element_at(kind, p["param"])
        want = F.coalesce(*(F.when(p["type"] == name, F.lit(f"^({pattern})$")) for name, pattern in _TYPES.items()), F.lit(".*"))
        return F.when(got.isNull() & p["required"], F.concat(F.lit("missing "), p["param"])).when(
            ~F.regexp_like(got, want) & (got != "OBJECT<`$result`: STRING>"), F.concat(F.lit("type of "), p["param"])
        )

    extra = F.transform(F.array_except(F.map_keys(values), F.transform(params, lambda p: p["param"])), lambda k: F.concat(F.lit("unexpected "), k))
    listed = F.concat(F.filter(F.transform(params, wrong), lambda x: x.isNotNull()), extra)
    none = F.array().cast("array<string>")
    return F.when(values.isNull(), F.array(F.lit("arguments are no object"))).when(~known, F.array(F.lit("unknown tool"))).otherwise(F.coalesce(F.array_sort(listed), none))


def _placed(spots: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Places and levels behind all calls that a call depends on.

    A call with one need is a link of a chain, and chains are followed by doubling: each link jumps to the end of its chain, with the length
    and the latest place on the way.  Only calls with several needs are settled round by round, behind the ends of their chains, until a
    round settles none.  ``stuck`` says of the calls that are left whether they are in a cycle or only wait for one; it is null for all others.
    """
    key = ["conv", "call_id"]
    spots = scratch.table("spots", spots)
    needs = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("needs"))
    single = edges.join(needs.filter("needs = 1"), key, "left_semi")
    links = single.join(spots.select(*key, "at"), key).select(*key, F.col("dep").alias("end"), F.lit(1).alias("length"), F.col("at").alias("top"))
    chains, ringed = _chained(scratch.table("links-0", links), scratch)

    # What isn't a link: calls without needs, settled at once, and those with several, behind the ends of chains.
    waiting = edges.select(*key).distinct()
    fresh = scratch.table("settled-0", spots.join(waiting, key, "left_anti").withColumn("stuck", F.lit(None).cast("string")))
    several = edges.join(needs.filter("needs > 1"), key, "left_semi")
    hop = chains.select("conv", F.col("call_id").alias("dep"), "end", "length", "top")
    open_ = several.join(hop, ["conv", "dep"], "left").select(*key, "dep", F.coalesce("end", "dep").alias("end"), F.coalesce("length", F.lit(0)).alias("length"), "top")
    open_ = scratch.table("open-0", open_.withColumns({"dat": F.lit(None).cast("long"), "dlevel": F.lit(None).cast("int")}))
    i = 0
    while not (fresh.isEmpty() or open_.isEmpty()):
        i += 1
        done = fresh.select("conv", F.col("call_id").alias("end"), F.col("at").alias("fat"), F.col("level").alias("flevel"))
        filled = open_.join(done, ["conv", "end"], "left").select(*key, "dep", "end", "length", "top", F.coalesce("dat", F.greatest("fat", F.when(F.col("fat").isNotNull(), F.col("top")))).alias("dat"), F.coalesce("dlevel", F.col("flevel") + F.col("length")).alias("dlevel"))
        filled = scratch.table(f"open-{i}", filled)
        scratch.drop(f"open-{i - 1}")
        ready = filled.groupBy(*key).agg(F.max("dat").alias("dat"), F.max("dlevel").alias("dlevel"), F.bool_and(F.col("dlevel").isNotNull()).alias("ready")).filter("ready")
        fresh = scratch.table(f"settled-{i}", spots.join(ready, key).select(*key, F.greatest("at", "dat").alias("at"), (F.col("dlevel") + 1).alias("level"), F.lit(None).cast("string").alias("stuck")))
        open_ = filled.join(fresh.select(*key), key, "left_anti")
    ends = scratch.spark.read.schema(fresh.schema).parquet(*(f"{scratch.root}/settled-{k}" for k in range(i + 1)))
    behind = chains.join(ends.select("conv", F.col("call_id").alias("end"), F.col("at").alias("eat"), "level"), ["conv", "end"])
    behind = behind.select(*key, F.greatest("top", "eat").alias("at"), (F.col("level") + F.col("length")).alias("level"), F.lit(None).cast("string").alias("stuck"))
    settled = scratch.table("settled", ends.unionByName(behind))

    left = edges.join(settled.select(*key), key, "left_anti")
    if left.isEmpty():
        return settled
    left = scratch.table("left", left)
    known = left.join(settled.select("conv", F.col("call_id").alias("dep"), F.col("at").alias("dat"), F.col("level").alias("dlevel")), ["conv", "dep"], "left")
    after = known.groupBy(*key).agg(F.max("dat").alias("dat"), F.max("dlevel").alias("dlevel"))
    after = spots.join(after, key).select(*key, F.greatest("at", "dat").alias("at"), F.coalesce(F.col("dlevel") + 1, F.lit(0)).alias("level"))
    # Chains that only run into themselves are told by doubling; the closure is for cycles that calls with several needs are in.
    mixed = known.filter("dlevel IS NULL").select(*key, "dep").join(ringed.select(*key), key, "left_anti")
    mixed = mixed.join(ringed.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"], "left_anti")
    found = ringed.filter("ring").select(*key, F.lit("cycle").alias("stuck"))
    if not mixed.isEmpty():
        found = found.unionByName(_cyclic(mixed, scratch)).distinct()
    return settled.unionByName(after.join(found, key, "left").withColumn("stuck", F.coalesce("stuck", F.lit("waits for a cycle"))))


def _chained(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``links(conv, call_id, end, length, top)``, one for each call with one need → those that come to an end that is no link, with their whole length and
    latest place, and ``(conv, call_id, ring)`` for those that never do: ``ring`` tells the cycle itself from what leads into it.

    Every round doubles the jumps, so a round more than the logarithm of the number of links is enough; in a ring all jumps then lead to its members.
    """
    ids = ["conv", "call_id"]
    n, jumps, i = links.count(), links, 0
    while True:
        onward = jumps.select("conv", F.col("call_id").alias("end"), F.col("end").alias("far"), F.col("length").alias("more"), F.col("top").alias("high"))
        if 1 << i > n or jumps.join(onward, ["conv", "end"], "left_semi").isEmpty():
            break
        i += 1
        # lengths in rings mean nothing and are held back from overflowing
        further = F.least(F.col("length") + F.coalesce("more", F.lit(0)), F.lit(1 << 30)).cast("int")
        jumps = scratch.table(f"links-{i}", jumps.join(onward, ["conv", "end"], "left").select(*ids, F.coalesce("far", "end").alias("end"), further.alias("length"), F.greatest("top", "high").alias("top")))
        scratch.drop(f"links-{i - 1}")
    endless = scratch.table("endless", jumps.join(jumps.select("conv", F.col("call_id").alias("end")), ["conv", "end"], "left_semi").select(*ids, "end"))
    ring = endless.select("conv", F.col("end").alias("call_id"), F.lit(True).alias("ring")).distinct()
    ringed = endless.select(*ids).join(ring, ids, "left").select(*ids, F.coalesce("ring", F.lit(False)).alias("ring"))
    return jumps.join(endless.select(*ids), ids, "left_anti"), ringed


def _cyclic(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv, call_id, stuck)`` of the calls that reach themselves: calls on which none depends are taken out, the others' paths doubled."""
    n, before, i = edges.count(), -1, 0
    while n != before:
        needed = edges.select("conv", F.col("dep").alias("call_id")).distinct()
        edges = scratch.table(f"core-{i}", edges.join(needed, ["conv", "call_id"], "left_semi"))
        before, n, i = n, edges.count(), i + 1
    paths, before, i = edges, -1, 0
    while n != before:
        further = paths.withColumnRenamed("dep", "via").join(paths.select("conv", F.col("call_id").alias("via"), "dep"), ["conv", "via"]).select("conv", "call_id", "dep")
        paths = scratch.table(f"paths-{i}", paths.unionByName(further).distinct())
        before, n, i = n, paths.count(), i + 1
    return paths.filter("call_id = dep").select("conv", "call_id", F.lit("cycle").alias("stuck"))


def formatted(turns: DataFrame, tools: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Lines of canonical JSON: ``(conv_col, turn, idx, kind, role, call_id, linked, valid, problems, at, level, step, json)``.

    Every turn gives a line, every call one more; nothing is dropped.  ``tools`` has rows ``(tool, param, type, required)``, with a null
    ``param`` for a tool without parameters; without it, any object passes.  ``linked``: a call that has a result, a result
    that has a call (null for messages).  Of several calls with one identifier the first by turn and
    place counts, the others are ``duplicate``; so with results.  Calls in a cycle are reported as ``cycle``, others that need
    their results as ``waits for a cycle``; a chain of calls may have any length.
    ``valid`` is false where there is any problem.  A null text is a message of null content, which is left out of its line; null roles and turns
    stay null, and null turns come first.  A null conversation's calls and results are never linked.  Text that isn't JSON, or
    has a key twice, is plain text.  Repeated rows come back as often.  Other columns are ignored; an empty table gives an empty table.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    lines = scratch.table("lines", _lines(turns, conv_col, turn_col, role_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    linkable = lines.filter("kind <> 'message' AND call_id IS NOT NULL AND conv IS NOT NULL")
    place = F.struct("turn", "idx", "row")
    firsts = scratch.table("firsts", linkable.groupBy("conv", "call_id").agg(F.min(F.when(F.col("kind") == "call", place)).alias("call"), F.min(F.when(F.col("kind") == "result", place)).alias("result")))

    needs = lines.filter("kind = 'call' AND args LIKE '%$result%'").select("row", "conv", "call_id", F.expr("""
        filter(transform(map_values(from_json(args, 'map<string,variant>')), x -> try_variant_get(x, "$['$result']", 'string')), x -> x IS NOT NULL)""").alias("deps"))
    edges = needs.select("conv", "call_id", F.explode("deps").alias("dep")).distinct()
    spots = firsts.filter("call IS NOT NULL").select("conv", "call_id", F.col("call.turn").alias("at"), F.lit(0).alias("level"))
    edges = scratch.table("edges", edges.join(spots.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"], "left_semi"))
    spots = spots.withColumn("stuck", F.lit(None).cast("string")) if edges.isEmpty() else _placed(spots, edges, scratch)

    facts = firsts.join(spots, ["conv", "call_id"], "left")
    rows = lines.filter("kind = 'message'").unionByName(lines.filter("kind <> 'message' AND (call_id IS NULL OR conv IS NULL)")).select(
        "*", F.lit(None).cast("struct<turn:bigint,idx:int,row:bigint>").alias("call"), F.lit(None).cast("struct<turn:bigint,idx:int,row:bigint>").alias("result"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("stuck")
    )
    rows = rows.unionByName(linkable.join(facts, ["conv", "call_id"]))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    first = F.when(is_call, F.col("call.row") == F.col("row")).when(is_result, F.col("result.row") == F.col("row"))
    linked = F.when(is_call, F.coalesce(first & F.col("result").isNotNull(), F.lit(False))).when(is_result, F.coalesce(first & F.col("call").isNotNull(), F.lit(False)))
    follows = is_result & F.col("call").isNotNull()
    rows = rows.withColumns({
        "linked": linked,
        "first": F.coalesce(first, F.lit(False)),
        "at": F.when(is_call | follows, F.greatest("turn", F.coalesce("at", "turn"))).otherwise(F.col("turn")),
        "level": F.when(is_call | follows, F.coalesce("level", F.lit(0))).otherwise(0),
        "step": F.when(is_result, 2).when(is_call, 1).otherwise(0),
    })

    none = F.array().cast("array<string>")
    if tools is None:
        checked = rows.withColumns({"params": F.lit(None).cast("array<struct<param:string,type:string,required:boolean>>"), "known": F.lit(True)})
        argued = F.when(F.from_json("args", "map<string,variant>").isNull(), F.array(F.lit("arguments are no object"))).otherwise(none)
    else:
        known = tools.select(F.col("tool").alias("t"), "param", "type", F.coalesce("required", F.lit(False)).alias("required")).groupBy("t")
        known = known.agg(F.filter(F.collect_list(F.struct("param", "type", "required")), lambda p: p["param"].isNotNull()).alias("params"))
        checked = rows.join(known, F.col("tool") == F.col("t"), "left").withColumn("known", F.col("t").isNotNull())
        argued = _problems(F.col("args"), F.col("known"), F.col("params"))
    problems = F.concat(
        F.when(~F.coalesce(is_call | is_result, F.lit(False)), none).when(F.col("call_id").isNull(), F.array(F.lit("no identifier"))).when(F.col("first"), none).otherwise(F.array(F.lit("duplicate"))),
        F.when(is_result & F.col("first") & F.col("call").isNull(), F.array(F.lit("no call"))).otherwise(none),
        F.when(F.col("stuck").isNotNull() & is_call, F.array("stuck")).otherwise(none),
        F.when(is_call, argued).otherwise(none),
    )
    args = F.coalesce(F.try_parse_json("args"), F.parse_json(F.to_json(F.struct(F.col("args").alias("text")))))
    line = F.when(is_call, F.to_json(F.struct(args.alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"), "role", F.lit("call").alias("type")))).when(
        is_result, F.to_json(F.struct("content", F.col("call_id").alias("id"), "role", F.lit("result").alias("type")))).otherwise(F.to_json(F.struct("content", "role")))
    out = checked.withColumns({"problems": problems, "json": line})
    return out.select(F.col("conv").alias(conv_col), "turn", "idx", "kind", "role", "call_id", "linked", (F.size("problems") == 0).alias("valid"), F.array_join("problems", "; ").alias("problems"), "at", "level", "step", "json")
