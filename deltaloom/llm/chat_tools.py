"""Chat formatting: tool calls linked to results, ordered, validated, written as canonical JSON.

Everything is DataFrame operations and SQL functions. A message of a conversation may call
tools (an assistant's text that is a JSON object with ``tool_calls``: id, name, arguments,
depends_on) or answer a call (role ``tool``, a JSON object with ``tool_call_id`` and
``content``); any other text is a plain message. Plain exchanges can be read as calls too:
a user's turn asks, and the assistant's turn right after it answers.

* Links: calls and results are hash-joined by (conversation, identifier). The first call
  and the first result of an identifier count; others are kept and marked.
* Order: a result comes after its call, a call after the calls it depends on; apart from
  that messages keep their turns. In conversations in which a call stands before one that it
  needs, calls are peeled off by their dependencies: a call settles once all that it needs
  has settled, right behind the last of those if it stood before it. What never settles is
  in a cycle (a call that needs itself is one), or behind one, and is marked.
* Validation: arguments against (name, param, type, required) rows, with allowed values if
  there is such a column.
* Canonical JSON: keys in order, no white space, one form for each number.

No conversation is gathered anywhere: positions are counted in ranges of (conversation,
order) and the ranges' sizes are added up, so a conversation with a third of all messages
is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise

CALL = "array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"
#: What a plain exchange's call has as arguments.
EXCHANGE_SCHEMA = [("respond", "text", "string", True), ("respond", "turn", "integer", True)]


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), and a number that tells equal rows' places apart."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def _listed() -> F.Column:
    """The calls that an assistant's text holds; null if it holds none."""
    calls = F.filter(F.from_json(F.get_json_object("text", "$.tool_calls"), CALL), lambda c: c.isNotNull())
    return F.when((F.col("role") == "assistant") & (F.size(calls) > 0), calls)


def find_calls(rows: DataFrame, exchanges: bool = True) -> DataFrame:
    """(conv_id, turn, idx, call_id, name, arguments, depends_on) of all calls."""
    real = rows.select("conv_id", "turn", F.posexplode(_listed()).alias("idx", "c"))
    real = real.select("conv_id", "turn", "idx", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    if not exchanges:
        return real
    asked = rows.where("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("idx"), F.concat(F.lit("turn:"), F.col("turn")).alias("call_id"), F.lit("respond").alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), "turn")).alias("arguments"), F.array().cast("array<string>").alias("depends_on"),
    )
    return real.unionByName(asked)


def find_results(rows: DataFrame, exchanges: bool = True) -> DataFrame:
    """(conv_id, turn, call_id, content) of all results."""
    real = rows.where("role = 'tool'").select("conv_id", "turn", F.get_json_object("text", "$.tool_call_id").alias("call_id"), F.coalesce(F.get_json_object("text", "$.content"), "text").alias("content"))
    if not exchanges:
        return real
    plain = rows.where("role = 'assistant'").where(_listed().isNull())
    return real.unionByName(plain.select("conv_id", "turn", F.concat(F.lit("turn:"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")))


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds ``canonical`` (arguments as canonical JSON, null if they're no object) and ``errors``.

    Errors, in order: ``unknown tool``, ``not an object``, then by parameter ``missing x``,
    ``type x``, ``value x``, ``unexpected x``. A tool's parameters are one row each of
    ``schemas``: types are string, integer, number, boolean, object, array, array<type> of one
    of the first four, or anything else for any type; ``allowed``, if there is such a column,
    is an array of the values that are allowed, as text, or null.
    """
    if "allowed" not in schemas.columns:
        schemas = schemas.withColumn("allowed", F.lit(None).cast("array<string>"))
    tools = schemas.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("param", "type", "required", "allowed"))).alias("params"))
    # a schema is a few rows a tool: the join's smaller side, which Spark sizes itself
    known = calls.join(tools, "name", "left").withColumn("v", F.try_parse_json("arguments"))
    kinds = F.expr("transform_values(from_json(CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN arguments END, 'map<string,variant>'), (k, x) -> schema_of_variant(x))")
    known = known.withColumn("kinds", kinds).withColumn("given", F.from_json(F.when(F.col("kinds").isNotNull(), F.col("arguments")), "map<string,string>"))
    fits = """CASE p.type WHEN 'string' THEN kinds[p.param] = 'STRING' WHEN 'integer' THEN kinds[p.param] = 'BIGINT'
        WHEN 'number' THEN kinds[p.param] = 'BIGINT' OR kinds[p.param] = 'DOUBLE' OR kinds[p.param] LIKE 'DECIMAL%'
        WHEN 'boolean' THEN kinds[p.param] = 'BOOLEAN' WHEN 'object' THEN kinds[p.param] LIKE 'OBJECT%'
        WHEN 'array' THEN kinds[p.param] LIKE 'ARRAY%' WHEN 'array<string>' THEN kinds[p.param] RLIKE '^ARRAY<(STRING|VOID)>$'
        WHEN 'array<integer>' THEN kinds[p.param] RLIKE '^ARRAY<(BIGINT|VOID)>$' WHEN 'array<number>' THEN kinds[p.param] RLIKE '^ARRAY<(BIGINT|DOUBLE|DECIMAL.*|VOID)>$'
        WHEN 'array<boolean>' THEN kinds[p.param] RLIKE '^ARRAY<(BOOLEAN|VOID)>$' ELSE true END"""
    wrong = F.expr(f"""CASE WHEN params IS NULL THEN array('unknown tool') WHEN kinds IS NULL THEN array('not an object') ELSE concat(
        transform(filter(params, p -> NOT map_contains_key(kinds, p.param) AND p.required), p -> concat('missing ', p.param)),
        transform(filter(params, p -> map_contains_key(kinds, p.param) AND NOT coalesce({fits}, true)), p -> concat('type ', p.param)),
        transform(filter(params, p -> map_contains_key(kinds, p.param) AND NOT coalesce(array_contains(p.allowed, given[p.param]), true)), p -> concat('value ', p.param)),
        transform(array_sort(filter(map_keys(kinds), k -> NOT exists(params, p -> p.param = k))), k -> concat('unexpected ', k))) END""")
    return known.withColumn("errors", wrong).withColumn("canonical", F.expr("CASE WHEN kinds IS NOT NULL THEN to_json(v) END")).drop("params", "v", "kinds", "given")


def settle(calls: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``at_turn``, ``level``, ``cyclic`` and ``unknown``; and the number of rounds taken.

    ``calls`` has one row for each (conv_id, call_id). ``unknown`` lists what a call needs
    but no call of its conversation is. A round settles all calls whose needs have settled;
    it writes only those, so there are as many rounds as the longest chain of needs has
    calls, and one that finds none.
    """
    spark = calls.sparkSession
    own = calls.select("conv_id", "call_id", "turn", "idx")
    needs = calls.where("size(depends_on) > 0").select("conv_id", "call_id", "turn", "idx", F.explode(F.array_distinct("depends_on")).alias("need")).where("need IS NOT NULL")
    needs = materialise(needs.join(own.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("n_turn"), F.col("idx").alias("n_idx"), F.lit(True).alias("known")), ["conv_id", "need"], "left"), "needs")
    start = calls.withColumns({"at_turn": F.col("turn"), "level": F.lit(0).cast("long"), "cyclic": F.lit(False), "unknown": F.array().cast("array<string>")})
    if needs.isEmpty():
        return start, 0
    unknown = needs.where("known IS NULL").groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("need")).alias("unknown"))
    # a conversation without a call before its need is in order, and so has no cycle
    behind = needs.where("known AND struct(n_turn, n_idx) >= struct(turn, idx)").select("conv_id").distinct()
    edges = materialise(needs.where("known").join(behind, "conv_id", "left_semi").select("conv_id", "call_id", "turn", "idx", "need", "n_turn", "n_idx"), "edges")
    place = "conv_id long, call_id string, at_turn long, level long, turn long, idx int"
    paths, rounds = [], 0
    # first those that need nothing
    front = edges.select("conv_id", F.col("need").alias("call_id"), F.col("n_turn").alias("at_turn"), F.lit(0).cast("long").alias("level"), F.col("n_turn").alias("turn"), F.col("n_idx").alias("idx")).distinct()
    front = front.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    while True:
        path, seen = fresh_path(spark, "settled"), Observation()
        front.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        if not seen.get["n"]:
            break
        paths.append(path)
        rounds += 1
        new = spark.read.schema(place).parquet(path).select("conv_id", F.col("call_id").alias("need"))
        done = spark.read.schema(place).parquet(*paths).select("conv_id", F.col("call_id").alias("need"), F.struct("at_turn", "level", "turn", "idx").alias("at"))
        touched = edges.join(new, ["conv_id", "need"], "left_semi").select("conv_id", "call_id").distinct()
        open_edges = edges.join(touched, ["conv_id", "call_id"], "left_semi").join(done, ["conv_id", "need"], "left")
        ready = open_edges.groupBy("conv_id", "call_id", "turn", "idx").agg(F.max("at").alias("last"), F.max(F.struct("at.at_turn", "at.level")).alias("after"), (F.count("at") == F.count("*")).alias("ready")).where("ready")
        late = F.expr("last >= struct(turn AS at_turn, 0L AS level, turn, idx)")
        front = ready.select("conv_id", "call_id", F.when(late, F.col("after.at_turn")).otherwise(F.col("turn")).alias("at_turn"), F.when(late, F.col("after.level") + 1).otherwise(0).alias("level"), "turn", "idx")
    done = (spark.read.schema(place).parquet(*paths) if paths else spark.createDataFrame([], place)).select("conv_id", "call_id", "at_turn", "level")
    stuck = edges.select("conv_id", "call_id").distinct().join(done, ["conv_id", "call_id"], "left_anti").withColumn("cyclic", F.lit(True))
    found = calls.join(done, ["conv_id", "call_id"], "left").join(stuck, ["conv_id", "call_id"], "left").join(unknown, ["conv_id", "call_id"], "left")
    return found.withColumns({"at_turn": F.coalesce("at_turn", "turn"), "level": F.coalesce("level", F.lit(0).cast("long")), "cyclic": F.coalesce("cyclic", F.lit(False)), "unknown": F.coalesce("unknown", F.array().cast("array<string>"))}), rounds


def format_chats(conversations: DataFrame, schemas: DataFrame | None = None, exchanges: bool = True) -> DataFrame:
    """One row per message, call and result, in an order that respects all links.

    conv_id, position (from 0 in each conversation), turn, kind (message, call, result),
    role, call_id, partner_turn (of the result for a call, of the call for a result),
    status (``linked``; ``no result`` or ``no call``; ``repeated`` for a later call or
    result of an identifier; ``no identifier``; ``cyclic``; null for messages), valid and
    errors (calls; what a call needs but no call is gives ``unknown dependency x``) and
    ``json``, the canonical JSON of the row. What an assistant says beside its calls is a
    message of its own; a text that holds no call is a message (or a result, see above).

    Null texts are empty, null roles ``unknown``; null turns come first; rows without
    conv_id form one conversation in which nothing links. Repeated rows are all kept: later
    ones of an identifier are marked. Other columns are ignored.
    """
    spark = conversations.sparkSession
    if schemas is None:
        schemas = spark.createDataFrame(EXCHANGE_SCHEMA, "name string, param string, type string, required boolean")
    rows = messages(conversations)
    calls = find_calls(rows, exchanges).withColumn("uid", F.xxhash64("turn", "idx", "name", "arguments"))
    results = find_results(rows, exchanges).withColumn("uid", F.xxhash64("turn", "content"))

    def first(frame: DataFrame) -> DataFrame:
        """The first of each identifier, marked; of equal rows one, by a number of its own."""
        keyed = materialise(frame.withColumn("row", F.monotonically_increasing_id()), "keyed")
        lead = keyed.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "uid", "row")).alias("lead")).select(F.col("lead.row").alias("row"), F.lit(True).alias("is_first"))
        return keyed.join(lead, "row", "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))

    calls, results = first(calls), first(results)
    settled = settle(calls.where("is_first").drop("is_first"))[0].withColumn("is_first", F.lit(True))
    rest = calls.where("NOT is_first").withColumns({"at_turn": F.col("turn"), "level": F.lit(0).cast("long"), "cyclic": F.lit(False), "unknown": F.array().cast("array<string>")})
    checked = validate(settled.unionByName(rest), schemas).withColumn("errors", F.expr("concat(errors, transform(unknown, u -> concat('unknown dependency ', u)))"))
    calls = materialise(checked.drop("unknown"), "calls")
    answers = results.where("is_first").select("conv_id", "call_id", F.col("turn").alias("partner_turn"), F.lit(True).alias("answered")).hint("SHUFFLE_HASH")
    asked = calls.where("is_first").select("conv_id", "call_id", F.col("turn").alias("partner_turn"), F.col("at_turn").alias("c_turn"), F.col("level").alias("c_level"), "cyclic", F.lit(True).alias("called")).hint("SHUFFLE_HASH")
    key = ["conv_id", "call_id"]

    linked = calls.where("is_first").join(answers, key, "left").unionByName(calls.where("NOT is_first"), allowMissingColumns=True)
    call_rows = linked.select(
        "conv_id", "turn", F.lit("call").alias("kind"), F.lit("assistant").alias("role"), "call_id", "partner_turn",
        F.expr("CASE WHEN conv_id IS NULL OR call_id IS NULL THEN 'no identifier' WHEN NOT is_first THEN 'repeated' WHEN cyclic THEN 'cyclic' WHEN answered THEN 'linked' ELSE 'no result' END").alias("status"),
        (F.size("errors") == 0).alias("valid"), "errors", "at_turn", "level", F.lit(1).alias("after"), "idx", "uid",
        F.expr("to_json(struct(coalesce(parse_json(canonical), to_variant_object(struct(arguments AS raw))) AS arguments, call_id AS id, name, 'call' AS type))").alias("json"),
    )
    found = results.where("is_first").join(asked, key, "left").unionByName(results.where("NOT is_first"), allowMissingColumns=True)
    behind = F.expr("called AND c_turn >= coalesce(turn, c_turn)")
    result_rows = found.select(
        "conv_id", "turn", F.lit("result").alias("kind"), F.lit("tool").alias("role"), "call_id", "partner_turn",
        F.expr("CASE WHEN conv_id IS NULL OR call_id IS NULL THEN 'no identifier' WHEN NOT is_first THEN 'repeated' WHEN called THEN 'linked' ELSE 'no call' END").alias("status"),
        F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("array<string>").alias("errors"),
        F.when(behind, F.col("c_turn")).otherwise(F.col("turn")).alias("at_turn"), F.when(behind, F.col("c_level")).otherwise(F.lit(0).cast("long")).alias("level"), F.lit(2).alias("after"), F.lit(0).alias("idx"), "uid",
        F.expr("to_json(struct(coalesce(content, '') AS content, call_id AS id, 'result' AS type))").alias("json"),
    )
    # beside calls only what is said in words; a plain exchange's turns are calls and results
    calling = F.col("calling")
    marked = rows.withColumn("calling", _listed().isNotNull()).where("NOT coalesce(role, '') = 'tool'")
    plain = marked.where(~calling & ~F.coalesce("role", F.lit("")).isin(["user", "assistant"] if exchanges else [])).drop("calling")
    beside = marked.where(calling).withColumn("text", F.get_json_object("text", "$.content")).where("text <> ''").drop("calling")
    plain = plain.union(beside)
    message_rows = plain.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.coalesce("role", F.lit("unknown")).alias("role"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("partner_turn"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("array<string>").alias("errors"), F.col("turn").alias("at_turn"), F.lit(0).cast("long").alias("level"), F.lit(0).alias("after"), F.lit(0).alias("idx"), F.xxhash64("turn", "role", "text").alias("uid"),
        F.expr("to_json(struct(coalesce(text, '') AS content, coalesce(role, 'unknown') AS role, 'message' AS type))").alias("json"),
    )
    return _positions(call_rows.unionByName(result_rows).unionByName(message_rows))


def _positions(rows: DataFrame) -> DataFrame:
    """Adds each row's place in its conversation, from 0."""
    order = ["conv_id", "at_turn", "level", "after", "turn", "idx", "uid"]
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "dealt")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    # one row for each conversation and range
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = base.select(F.col("conv_id").alias("b_conv"), F.col("part").alias("b_part"), "base")
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:])) - 1
    placed = dealt.withColumn("own", own).join(base, F.expr("conv_id <=> b_conv AND part = b_part"))
    return placed.select("conv_id", (F.col("base") + F.col("own")).alias("position"), "turn", "kind", "role", "call_id", "partner_turn", "status", "valid", "errors", "json")
