"""Chat messages as canonical JSON, with tool calls linked to their results.

A message's text may be a JSON object. An assistant's object with ``tool_calls`` (a list of ``id``,
``name`` and ``arguments``) makes calls; a tool's object with ``tool_call_id`` (and ``content``) is a
result. Any other text is plain, also an object that does not parse.

1. Calls and results of a conversation are joined by identifier (a hash join on conversation and
   identifier, each side reduced to one row per identifier first, so a repeated identifier makes no
   pairs).
2. A call may name another call's result in its arguments as ``$call:<id>``. Levels are assigned in
   topological order: a call without references has level 0, another one more than the highest it
   names. What cannot get a level is on a cycle or names an unknown call. A linked result is placed
   behind its call, at the call's level, wherever it stood.
3. Arguments are checked against the tool's schema: required and optional names and JSON types. A
   message of any role may declare tools for its conversation, as ``{"tools": [{"name": .., "parameters":
   {"properties": {<argument>: {"type": ..}}, "required": [..]}}]}``, each tool plainly or below ``function``;
   calls meet declarations by conversation and name. Tools that the conversation does not declare are
   looked up in the caller's schemas.
4. A message is serialised with sorted keys, no blanks, numbers in one form; NULL text is ``null``.

The result is one row per message with an order inside its conversation, not one text per
conversation, so a conversation of any length is spread like any other rows.

Defined results: rows that repeat a message are all kept; of calls or results that repeat an
identifier the first (by turn, then by place in the message) counts and the others are
``repeated``. A NULL conversation or identifier links nothing; a NULL turn is ordered first. Of a
conversation's declarations of one name the first (by turn, then by place) counts, wherever the call
stands; a declaration without properties takes no arguments; a type that is none of JSON's is not checked. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablescout.session import materialize

#: Argument types per tool: name -> (JSON type, required). Types: string, integer, number, boolean, object, array.
Schemas = dict[str, dict[str, tuple[str, bool]]]
_TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT",
          "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
_REFERENCE = r"\$call:([A-Za-z0-9_.-]+)"


#: Stand for escapes while a text is cut at its quotes; JSON holds no such character as it is.
_BACKSLASH, _QUOTE = "\u0001", "\u0002"
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_VALID = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"


def _one_number(token: Column) -> Column:
    """The text of a number's value: as a decimal if that is the same number to double precision, else as a double."""
    double = token.cast("double")
    plain = F.regexp_replace(F.regexp_replace(token.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole = token.try_cast("decimal(38,0)")
    plain = F.when(plain.cast("double") == double, plain).when(whole.cast("double") == double, whole.cast("string"))
    return F.when(double == 0, "0").otherwise(F.coalesce(plain, double.cast("string")))


def with_one_form(text: Column) -> Column:
    """JSON with every number outside strings in one form: ``1e2``, ``100.0`` and ``100`` are all ``100``.

    Cut at its quotes (escaped ones put out of sight first) a text alternates between what is outside and
    what is inside strings.
    """
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def outside(part: Column) -> Column:
        tokens = F.regexp_extract_all(part, F.lit(f"{_NUMBER}|[^0-9-]+|-"), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(_VALID), _one_number(t)).otherwise(t)), "")

    parts = F.transform(F.split(hidden, '"'), lambda part, i: F.when(i % 2 == 0, outside(part)).otherwise(part))
    joined = F.array_join(parts, '"')
    return F.replace(F.replace(joined, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _quoted(value: Column) -> Column:
    """A string as JSON."""
    return F.coalesce(F.to_json(value.cast("variant")), F.lit("null"))


#: What a schema says of one argument.
_EXPECTED = "array<struct<argument: string, kind: string, required: boolean>>"


def _given(schemas: Schemas) -> Column:
    """The caller's schemas as a map from a tool's name to its arguments."""
    if not schemas:
        return F.lit(None).cast(f"map<string, {_EXPECTED}>")
    entries = []
    for tool, arguments in schemas.items():
        each = [F.struct(F.lit(a).alias("argument"), F.lit(kind).alias("kind"), F.lit(required).alias("required"))
                for a, (kind, required) in arguments.items()]
        entries += [F.lit(tool), F.array(*each).cast(_EXPECTED)]
    return F.create_map(*entries)


def declared(rows: DataFrame) -> DataFrame:
    """``conv_id, name, expected`` of the tools that parsed messages declare, one row per name."""
    tool = F.coalesce(F.try_variant_get("tool", "$.function", "variant"), F.col("tool"))
    each = rows.where(F.col("tools").isNotNull() & F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", "row", F.posexplode("tools").alias("place", "tool")).select(
        "conv_id", "turn", "row", "place", F.try_variant_get(tool, "$.name", "string").alias("name"),
        F.try_variant_get(tool, "$.parameters.properties", "map<string,variant>").alias("properties"),
        F.coalesce(F.try_variant_get(tool, "$.parameters.required", "array<string>"), F.array().cast("array<string>")).alias("required"))
    expected = F.transform(F.array_sort(F.map_keys("properties")), lambda a: F.struct(
        a.alias("argument"), F.try_variant_get(F.element_at("properties", a), "$.type", "string").alias("kind"),
        F.array_contains("required", a).alias("required")))
    # A name that is required but not described must be there, of any type.
    bare = F.transform(F.array_sort(F.array_except("required", F.coalesce(F.map_keys("properties"), F.array().cast("array<string>")))),
                       lambda a: F.struct(a.alias("argument"), F.lit(None).cast("string").alias("kind"), F.lit(True).alias("required")))
    whole = F.concat(F.coalesce(expected, F.array().cast(_EXPECTED)), bare).cast(_EXPECTED)
    return each.where(F.col("name").isNotNull()).groupBy("conv_id", "name").agg(
        F.min_by(whole, F.struct("turn", "place", "row")).alias("expected"))


def _argument_error(arguments: Column, expected: Column) -> Column:
    """``valid``, or what is wrong with a call's arguments; without a schema ``unknown_tool``."""
    kinds = F.create_map(*(F.lit(x) for pair in _TYPES.items() for x in pair))
    # The arguments' types; a JSON null counts as absent.
    found = F.transform_values(F.try_variant_get(arguments, "$", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))

    def wrong(e: Column) -> Column:
        kind = F.try_element_at(found, e["argument"])
        return (F.when(kind.isNull() | (kind == "VOID"), F.when(e["required"], F.concat(F.lit("missing:"), e["argument"])))
                .when(~F.regexp_like(kind, F.concat(F.lit("^("), F.try_element_at(kinds, e["kind"]), F.lit(")"))),
                      F.concat(F.lit("wrong_type:"), e["argument"])))

    first = F.try_element_at(F.filter(F.transform(expected, wrong), lambda x: x.isNotNull()), F.lit(1))
    unexpected = F.array_sort(F.array_except(F.map_keys(found), F.transform(expected, lambda e: e["argument"])))
    return (F.when(expected.isNull(), "unknown_tool")
            .when(~F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False)), "not_an_object")
            .otherwise(F.coalesce(first, F.concat(F.lit("unexpected:"), F.try_element_at(unexpected, F.lit(1))), F.lit("valid"))))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with their calls, the identifier and content of their result, and the tools they declare."""
    rows = messages.select("conv_id", "turn", "role", "text").withColumn(
        "v", F.when(F.ltrim("text").startswith("{"), F.try_parse_json(with_one_form(F.col("text")))))
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    return rows.withColumns({
        "calls": F.transform(calls, lambda c: F.struct(
            F.try_variant_get(c, "$.id", "string").alias("id"), F.try_variant_get(c, "$.name", "string").alias("name"),
            F.try_variant_get(c, "$.arguments", "variant").alias("arguments"))),
        "result_id": F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")),
        "content": F.try_variant_get("v", "$.content", "variant"),
        "tools": F.try_variant_get("v", "$.tools", "array<variant>"),
    })


def _chains(needs: DataFrame) -> DataFrame:
    """``conv_id, call_id, root, steps``: for calls with one need, the first call up the chain that has
    none or several (or is unknown), by pointer doubling: a round doubles the steps that each call looks up.

    What is still on its way after as many rounds as the number of calls has binary digits is on a cycle.
    """
    single = needs.where(F.size("needs") == 1).select("conv_id", "call_id", F.col("needs")[0].alias("root"), F.lit(1).cast("long").alias("steps"))
    single = materialize(single, "chains")
    settled, moving = [], single
    for _ in range(max(1, single.count().bit_length() + 1)):
        above = moving.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("_root"), F.col("steps").alias("_steps"))
        if settled:
            above = above.unionByName(reduce(DataFrame.unionByName, settled).select(
                "conv_id", F.col("call_id").alias("root"), F.col("root").alias("_root"), F.col("steps").alias("_steps")))
        met = materialize(moving.join(above, ["conv_id", "root"], "left").select(
            "conv_id", "call_id", F.coalesce("_root", "root").alias("root"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_root").isNull().alias("_there")), "chains")
        settled.append(met.where("_there").drop("_there"))
        moving = met.where("not _there").drop("_there")
        if moving.isEmpty():
            break
    return reduce(DataFrame.unionByName, settled)


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of ``calls(conv_id, call_id, needs)`` in topological order.

    Chains of calls with one need each are jumped by pointer doubling, so that the rounds that remain are
    those of calls with several needs. A round takes the calls whose needs all have a level and writes
    them and what is still open, not the levels so far.
    """
    done = calls.where(F.size("needs") == 0).select("conv_id", "call_id", F.lit(0).cast("long").alias("level"))
    if calls.where(F.size("needs") > 0).isEmpty():
        return done.withColumn("level", F.col("level").cast("int"))
    found, chains = [materialize(done, "levels")], _chains(calls)
    # An open need is (the call, a call with no or several needs, steps from there to the need).
    open_ = calls.where(F.size("needs") > 1).select("conv_id", "call_id", F.explode("needs").alias("need")).join(
        chains.select("conv_id", F.col("call_id").alias("need"), "root", "steps"), ["conv_id", "need"], "left").select(
        "conv_id", "call_id", F.coalesce("root", "need").alias("root"), F.coalesce("steps", F.lit(0)).alias("steps"), F.lit(None).cast("long").alias("known"))
    open_ = materialize(open_, "needs")
    while not open_.isEmpty():
        fresh = found[-1].select("conv_id", F.col("call_id").alias("root"), "level")
        met = materialize(open_.join(fresh, ["conv_id", "root"], "left").withColumn(
            "known", F.coalesce("known", F.col("level") + F.col("steps"))).drop("level"), "needs")
        ready = met.groupBy("conv_id", "call_id").agg((F.max("known") + 1).alias("level"), F.count("known").alias("k"), F.count(F.lit(1)).alias("n"))
        ready = materialize(ready.where("k = n").drop("k", "n"), "levels")
        if ready.isEmpty():
            break  # what is left is on a cycle or names an unknown call
        found.append(ready)
        open_ = materialize(met.join(ready, ["conv_id", "call_id"], "left_anti"), "needs")
    top = reduce(DataFrame.unionByName, found)
    below = chains.join(top.withColumnRenamed("call_id", "root"), ["conv_id", "root"]).select(
        "conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level"))
    return top.unionByName(below).withColumn("level", F.col("level").cast("int"))


def link(messages: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row per message: ``conv_id, turn, role``, place (``anchor, level, slot``), ``json``, ``n_calls,
    n_answered, n_valid, call_issues`` of its calls, and ``link`` (``linked``, ``orphan``, ``repeated``) of a result."""
    rows = materialize(parsed(messages).withColumn("row", F.xxhash64("conv_id", "turn", "role", "text")), "messages")
    each = rows.select("conv_id", "turn", "row", F.posexplode("calls").alias("slot", "call")).select(
        "conv_id", "turn", "row", "slot", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    each = each.dropDuplicates(["conv_id", "turn", "row", "slot"])
    first = each.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min_by(
        F.struct("turn", "row", "slot", F.array_distinct(F.regexp_extract_all(F.to_json("arguments"), F.lit(_REFERENCE))).alias("needs")),
        F.struct("turn", "slot", "row")).alias("call"))
    first = materialize(first.select("conv_id", "call_id", F.col("call.turn").alias("call_turn"), F.col("call.row").alias("call_row"),
                                     F.col("call.slot").alias("call_slot"), F.coalesce("call.needs", F.array().cast("array<string>")).alias("needs")), "calls")
    answers = rows.where(F.col("result_id").isNotNull()).groupBy("conv_id", F.col("result_id").alias("call_id")).agg(
        F.min(F.struct("turn", "row")).alias("answer"))
    linked = first.join(levels(first), ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left")
    linked = materialize(linked.drop("needs"), "links")
    each = each.join(declared(rows), ["conv_id", "name"], "left")

    checked = each.join(linked.select("conv_id", "call_id", "call_turn", "call_row", "call_slot", "level", F.col("answer").isNotNull().alias("answered")),
                        ["conv_id", "call_id"], "left")
    counts = (F.col("turn").eqNullSafe(F.col("call_turn")) & (F.col("row") == F.col("call_row")) & (F.col("slot") == F.col("call_slot")))
    issue = F.when(F.col("call_id").isNull(), "no_id").when(~counts, "repeated_id").when(F.col("level").isNull(), "cycle_or_unknown_reference").otherwise(
        _argument_error(F.col("arguments"), F.coalesce("expected", F.try_element_at(_given(schemas or {}), F.col("name")))))
    body = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("arguments"), F.lit("null")), F.lit(',"id":'), _quoted(F.col("call_id")),
                    F.lit(',"name":'), _quoted(F.col("name")), F.lit("}"))
    by_message = checked.select("conv_id", "turn", "row", "slot", F.coalesce(counts & F.col("answered"), F.lit(False)).alias("answered"),
                                issue.alias("issue"), body.alias("body")).groupBy("conv_id", "turn", "row").agg(
        F.array_sort(F.collect_list(F.struct("slot", "body", "answered", "issue"))).alias("made"))  # one message's calls

    results = linked.where(F.col("answer").isNotNull()).select("conv_id", F.col("call_id").alias("result_id"), "call_turn", "call_slot", "level", "answer")
    # Messages without calls and results never enter a shuffle.
    plain = rows.where(F.col("calls").isNull() & F.col("result_id").isNull())
    calling = rows.where(F.col("calls").isNotNull()).alias("m").join(by_message.alias("b"), F.expr(
        "m.conv_id <=> b.conv_id and m.turn <=> b.turn and m.row = b.row"), "left").select("m.*", "b.made")
    answering = rows.where(F.col("result_id").isNotNull()).join(results, ["conv_id", "result_id"], "left")
    own = F.col("answer.turn").eqNullSafe(F.col("turn")) & (F.col("answer.row") == F.col("row"))
    is_linked = F.coalesce(own, F.lit(False))
    issues = F.array_join(F.array_distinct(F.filter(F.transform("made", lambda c: c["issue"]), lambda x: x != "valid")), ",")
    none = F.lit(0)
    text = _quoted(F.col("text"))
    content = F.coalesce(F.to_json("content"), F.lit("null"))

    def message(body: Column, extra: Column) -> Column:
        return F.concat(F.lit('{"content":'), body, F.lit(',"role":'), _quoted(F.col("role")), extra, F.lit("}"))

    def shaped(some: DataFrame, anchor, level, slot, json, n, answered, valid, found, state) -> DataFrame:
        return some.select("conv_id", "turn", "role", anchor.alias("anchor"), level.cast("int").alias("level"), slot.cast("int").alias("slot"), json.alias("json"),
                           n.cast("int").alias("n_calls"), answered.cast("int").alias("n_answered"), valid.cast("int").alias("n_valid"),
                           found.cast("string").alias("call_issues"), state.cast("string").alias("link"))

    nothing = F.lit(None)
    turn = F.col("turn")
    made = F.coalesce(F.array_join(F.transform("made", lambda c: c["body"]), ","), F.lit(""))
    one = shaped(plain, turn, none, none, message(text, F.lit("")), none, none, none, nothing, nothing)
    two = shaped(calling, turn, none, none, message(content, F.concat(F.lit(',"tool_calls":['), made, F.lit("]"))),
                 F.coalesce(F.size("made"), none), F.size(F.filter("made", lambda c: c["answered"])),
                 F.size(F.filter("made", lambda c: c["issue"] == "valid")), issues, nothing)
    three = shaped(answering, F.when(is_linked, F.col("call_turn")).otherwise(turn), F.when(is_linked, F.coalesce("level", none) + 1).otherwise(none),
                   F.when(is_linked, F.col("call_slot") + 1).otherwise(none),
                   message(content, F.concat(F.lit(',"tool_call_id":'), _quoted(F.col("result_id")))), none, none, none, nothing,
                   F.when(is_linked, "linked").when(F.col("answer").isNotNull(), "repeated").otherwise("orphan"))
    return one.unionByName(two).unionByName(three)


def write_conversations(linked: DataFrame, path: str, files: int) -> None:
    """JSON lines in order, a message each; a long conversation may span files."""
    order = ["conv_id", "anchor", "level", "slot", "turn"]
    linked.repartitionByRange(files, *order).sortWithinPartitions(*order).select(
        F.concat(F.lit('{"conv_id":'), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(',"message":'), F.col("json"), F.lit("}"))
    ).write.text(path)
