"""Chat formatting: link tool calls to their results, order them, validate arguments, serialise canonical JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Schema types, and how a JSON value of each type looks in canonical form.
TYPES = {
    "string": r'^".*', "integer": r"^-?[0-9]+$", "number": r"^-?[0-9].*", "boolean": "^(true|false)$", "array": r"^\[.*", "object": r"^\{.*",
}


def shortened(waiting: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges (conv_id, call_id, needed, steps) with chains taken at once.

    A call that waits for one call only is as many steps behind what that one waits for. Doubling such pointers
    until none moves takes as many rounds as the logarithm of the longest chain; pointers on a cycle would move
    for ever and are dropped when more rounds have passed than any chain of so many calls needs.
    """
    ids = ["conv_id", "call_id"]
    alone = waiting.groupBy(*ids).agg(F.min("needed").alias("needed"), F.count("*").alias("n"), F.lit(1).cast("long").alias("steps"))
    chain = stored(alone.filter("n = 1").select(*ids, "needed", "steps", F.lit(True).alias("moves")), "chain")
    for _ in range(max(1, chain.count()).bit_length() + 1):
        ahead = chain.select("conv_id", F.col("call_id").alias("needed"), F.col("needed").alias("beyond"), F.col("steps").alias("more"))
        joined = chain.filter("moves").join(ahead, ["conv_id", "needed"], "left")
        moved = joined.select(*ids, F.coalesce("beyond", "needed").alias("needed"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("beyond").isNotNull().alias("moves"))
        last, chain = chain, stored(moved.unionByName(chain.filter("not moves")), "chain")
        discard(last)
        if chain.filter("moves").isEmpty():
            break
    settled = chain.filter("not moves").select(*ids, "needed", "steps")
    many = waiting.join(alone.filter("n > 1").select(*ids), ids, "left_semi").withColumn("steps", F.lit(1).cast("long"))
    return stored(many.unionByName(settled), "waiting")


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for calls (conv_id, call_id, depends_on): 0 without known dependencies, else one
    more than the highest of them. Calls on a cycle or behind one are left out.

    Chains of calls with one dependency each are taken at once. What is left goes in rounds, each of which places
    all calls whose dependencies are placed, until a round places none; there is no bound of levels. Rounds are as
    many as calls with several dependencies follow each other.
    """
    ids = ["conv_id", "call_id"]
    nodes = calls.select(*ids)
    edges = calls.select(*ids, F.explode("depends_on").alias("needed")).distinct()
    known = nodes.select(F.col("conv_id"), F.col("call_id").alias("needed")).distinct()
    waiting = stored(edges.join(known, ["conv_id", "needed"]), "waiting")
    placed = stored(nodes.join(waiting.select(*ids).distinct(), ids, "left_anti").withColumn("level", F.lit(0).cast("long")), "level")
    if waiting.isEmpty():
        return placed
    open_, newest, parts = shortened(waiting, placed).withColumn("level", F.lit(None).cast("long")), placed, [placed]
    while True:
        done = newest.select("conv_id", F.col("call_id").alias("needed"), F.col("level").alias("found"))
        reached = open_.join(done, ["conv_id", "needed"], "left")
        open_ = stored(reached.select(*ids, "needed", "steps", F.coalesce("level", F.col("found") + F.col("steps")).alias("level")), "waiting")
        ready = open_.groupBy(*ids).agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("left"))
        newest = stored(ready.filter("left = 0").select(*ids, "level"), "level")
        if newest.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(newest)
        open_ = open_.join(newest.select(*ids), ids, "left_anti")


def _checked(arguments: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors) for arguments (conv_id, call_id, name, m): one error for each argument that is
    missing, unknown, given twice or of another type. A schema row without a ``param`` states a tool that takes none."""
    ids = ["conv_id", "call_id"]
    given = arguments.select(*ids, "name", F.explode("m").alias("e")).select(*ids, "name", F.col("e.key").alias("param"), F.col("e.value").alias("v"))
    given = given.groupBy(*ids, "name", "param").agg(F.min("v").alias("v"), F.count("*").alias("times"))
    known = schemas.select("name").distinct().withColumn("known", F.lit(True))
    params = schemas.filter("param is not null")
    both = arguments.filter("m is not null").select(*ids, "name").join(params, "name").join(given.drop("name"), [*ids, "param"], "left")
    pattern = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    fits = F.expr("v rlike pattern")
    wrong = both.withColumn("pattern", pattern[F.col("type")]).select(
        *ids, F.when(F.col("v").isNull(), F.when(F.col("required"), F.concat(F.lit("missing:"), "param"))).when(~fits, F.concat(F.lit("type:"), "param")).alias("error")
    )
    twice = given.filter("times > 1").select(*ids, F.concat(F.lit("repeated:"), "param").alias("error"))
    unknown = given.join(known, "name").join(params.select("name", "param"), ["name", "param"], "left_anti").select(*ids, F.concat(F.lit("unknown:"), "param").alias("error"))
    bad = arguments.filter("m is null").select(*ids, F.lit("not_an_object").alias("error"))
    tool = arguments.join(known, "name", "left_anti").select(*ids, F.lit("no_schema").alias("error"))
    errors = wrong.filter("error is not null").unionByName(twice).unionByName(unknown).unionByName(bad).unionByName(tool)
    return errors.groupBy(*ids).agg(F.array_join(F.array_sort(F.collect_set("error")), ",").alias("errors"))


#: Parts of a JSON text without white space: strings, numbers, the rest.
PARTS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def canonical(value: Column) -> Column:
    """JSON of a variant without white space, with sorted keys, and with one form for equal numbers: digits without an
    exponent or zeros at the end if ten decimal places or 38 digits hold the number, else as a double is written."""

    def one(part: Column) -> Column:
        exact, whole, double = part.try_cast("decimal(38,10)"), part.try_cast("decimal(38,0)"), part.try_cast("double")
        digits = F.regexp_replace(exact.cast("string"), "[.]?0+$", "")
        same = lambda number: F.coalesce(number.cast("double") == double, F.lit(False))
        number = F.when(same(exact), F.when(exact == 0, "0").otherwise(digits)).when(same(whole), whole.cast("string")).otherwise(double.cast("string"))
        return F.when(~part.rlike("^-?[0-9]"), part).otherwise(number)

    return F.array_join(F.transform(F.regexp_extract_all(F.to_json(value), F.lit(PARTS), 0), one), "")


def _wrapped(text: Column, front: str, back: str) -> Column:
    return F.concat(F.lit(front), text, F.lit(back))


def _entries(arguments: Column) -> Column:
    """Keys and canonical values of a JSON object in the order of the keys, repeated ones too; null for anything else.

    A parser stops behind the first value. Read inside an array and inside an object, a text with more behind its value fails
    in one of them: what closes the array early is no end of an object, and the other way round.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    listed = F.from_json(_wrapped(arguments, "[", "]"), "array<map<string,variant>>", strict)
    held = F.from_json(_wrapped(arguments, '{"v":', "}"), "map<string,map<string,variant>>", strict)
    entries = F.map_entries(F.when(F.size(listed) == 1, F.try_element_at(held, F.lit("v"))))
    return F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(canonical(e["value"]), F.lit("null")).alias("value"))))


def _any_json(text: Column) -> Column:
    """The variant of a text that is one JSON value from its begin to its end, else null."""
    listed, held = F.try_parse_json(_wrapped(text, "[", "]")), F.try_parse_json(_wrapped(text, '{"v":', "}"))
    alone = F.variant_get(listed, "$[0]", "variant").isNotNull() & F.variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.variant_get(held, "$.v", "variant"))


def _quoted(text: Column) -> Column:
    """A text as JSON; null is null."""
    json = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substring(json, F.lit(2), F.length(json) - 2))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, block: int = 1024) -> DataFrame:
    """One row per call (conv_id, call_id, turn, name, arguments, depends_on), linked and ordered.

    Results (conv_id, call_id, turn, content) are joined by identifier, the earliest one of each call; ``status``
    is linked, unanswered or early (its result stands before it). ``arguments`` is a JSON text, one object to its
    end with double
    quotes and without NaN or infinity (else ``not_an_object``), checked against
    ``schemas`` (name, param, type, required; a null param states a tool, which may have none): ``errors`` lists
    faults. Schemas are flat: the type of a nested value is checked, not its fields. ``level`` is the topological
    level, of any height (null on cycles and behind them), ``place`` the place in the conversation's topological
    order, ties by turn and identifier. ``message`` is the canonical JSON, in which a repeated argument key stands
    as often as it was given, and arguments that are no object as they are, or null if they are no JSON. Calls
    without a conv_id or call_id cannot be linked and are left out; so are results that name no call. Calls that
    share an identifier: the earliest counts. Identifiers in ``depends_on`` that no call has are ignored. Nulls
    elsewhere are null in the JSON; null turns come first and count as block 0. Extra columns are not read.
    """
    ids = ["conv_id", "call_id"]
    one = (
        calls.filter("conv_id is not null and call_id is not null").select(*ids, "turn", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
        .groupBy(*ids).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select(*ids, "c.*").withColumn("m", _entries(F.col("arguments")))
    )
    one = stored(one, "calls")
    answer = results.filter("conv_id is not null and call_id is not null").groupBy(*ids).agg(F.min(F.struct(F.col("turn").alias("result_turn"), F.col("content").alias("result"))).alias("r"), F.count("*").alias("n_results"))
    errors = _checked(one.select(*ids, "name", "m"), schemas)
    levels = topological_levels(one)
    linked = one.join(answer.select(*ids, "r.*", "n_results"), ids, "left").join(errors, ids, "left").join(levels, ids, "left")
    linked = stored(linked.withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / block)), "linked")
    # Places by blocks of turns, and blocks by runs of levels: a conversation of any length is ordered by many tasks.
    key = ["conv_id", "run", "level", "part"]
    blocks = linked.withColumn("run", F.floor(F.col("level") / block)).groupBy(*key).agg(F.count("*").alias("n"))
    before = lambda keys, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = blocks.groupBy("conv_id", "run").agg(F.sum("n").alias("n")).withColumn("run_before", before(["conv_id"], F.col("run").asc_nulls_last()))
    runs = runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "run_before")
    starts = blocks.withColumn("before", before(["conv_id", "run"], F.col("level").asc_nulls_last(), "part"))
    starts = starts.join(runs, (F.col("conv_id") == F.col("c")) & F.col("run").eqNullSafe(F.col("r")))
    within = F.row_number().over(Window.partitionBy("conv_id", "level", "part").orderBy(F.col("turn"), F.col("call_id")))
    placed = linked.withColumn("within", within).alias("l").join(
        starts.alias("b"), (F.col("l.conv_id") == F.col("b.conv_id")) & F.col("l.level").eqNullSafe(F.col("b.level")) & (F.col("l.part") == F.col("b.part"))
    ).select("l.*", (F.col("b.run_before") + F.col("b.before") + F.col("within")).cast("long").alias("place"))
    status = F.when(F.col("n_results").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked")
    whole = F.concat(F.lit("{"), F.array_join(F.transform("m", lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    fields = {  # in the order of their names
        "arguments": F.coalesce(whole, canonical(_any_json(F.col("arguments"))), F.lit("null")),
        "call_id": _quoted(F.col("call_id")), "conv_id": F.col("conv_id").cast("string"), "level": F.coalesce(F.col("level").cast("string"), F.lit("null")),
        "name": _quoted(F.col("name")), "result": _quoted(F.col("result")), "status": F.concat(F.lit('"'), status, F.lit('"')),
    }
    message = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items())), F.lit("}"))
    return placed.select(
        *ids, "turn", "name", "result_turn", F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), status.alias("status"),
        F.coalesce("errors", F.lit("")).alias("errors"), "level", "place", message.alias("message"),
    )


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as calls and results: each user turn calls ``reply``, and an assistant turn answers the turn before.

    A call depends on the user turn before it, and one whose turn is divisible by 6 also on the one that stands half
    as far into the conversation, where there are such. Every seventh turn gives its length as a text, every fifth
    leaves its own number out and gives an argument that the tool does not know. A null text is a missing one; a
    null turn has no identifier and is left out.
    """
    name = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"))
    call = lambda at: F.concat(name, at.cast("string"))
    turn, chars = F.col("turn"), F.length("text").alias("chars")
    half = (F.floor(turn / 4) * 2).cast("long")
    wrong_type = F.to_json(F.struct("turn", "text", F.length("text").cast("string").alias("chars")))
    wrong_names = F.to_json(F.struct("text", chars, F.lit(1).alias("more")))
    arguments = F.when(turn % 7 == 0, wrong_type).when(turn % 5 == 0, wrong_names).otherwise(F.to_json(F.struct("turn", "text", chars)))
    needs = F.when(turn > 0, F.when(turn % 6 == 0, F.array(call(turn - 2), call(half))).otherwise(F.array(call(turn - 2))))
    calls = turns.filter("role = 'user'").select("conv_id", call(turn).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    results = turns.filter("role = 'assistant'").select("conv_id", call(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


#: The one tool of conversation_calls: its arguments, their types, and whether they must be there.
REPLY_SCHEMA = [("reply", "text", "string", True), ("reply", "turn", "integer", True), ("reply", "chars", "integer", False)]
