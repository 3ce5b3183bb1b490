"""Chat formatting: links tool calls to their results and writes each message as canonical JSON, on DataFrame functions alone.

A message of an assistant whose text is a JSON object with ``tool_calls`` (each with id, name and arguments) holds calls;
a message of role ``tool`` whose text is a JSON object with ``tool_call_id`` (and content) is a result. Calls and results meet in a
hash join on conversation and identifier; of calls that share an identifier the first counts and the others are marked.
Order is topological: a result comes after its call, all else stays in order of turns. The order is given by
three columns (order_turn, order_rank, turn) and not by a running number, so no task ever needs a whole conversation, however
many of all rows it holds. Arguments are checked against the tools' schemas.

Canonical JSON has sorted keys, no spaces between tokens and no null fields; arguments are parsed and written anew in that form.

The table is read twice: once for messages with calls or results, which are written and then linked, and once for all others, which take no
part in any join and are never shuffled.

Types of arguments are those of the parsed JSON value: "5" is a string and 5 an integer. An integer is a number without a
fraction (1.0 and 1e3 count), a number is any. Null is of no type. Parameters that the schema does not name are unexpected.

Defined results: a null role is ``unknown``; null texts have no content; very long texts are content like others; results without a call are
marked orphan_result, calls without a result unanswered; a result before its call is put after it and marked out_of_order; arguments that are
no JSON object, or name a key twice, are marked bad_arguments and left out of the JSON; arguments may also come as a string that holds an
object; calls whose id is null or absent are kept, marked missing_id and link with nothing; repeated rows give repeated messages; rows with a
null conv_id link with nothing; an empty table gives an empty result; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import materialize

#: Tools by name; parameters by name: JSON type, and whether required. A registry is small: it becomes one literal.
SCHEMAS: Mapping[str, Mapping[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}
MAX_SCHEMAS = 10_000

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string>>, content string"
RESULT = "tool_call_id string, content string"


def _registry(schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    if sum(map(len, schemas.values())) > MAX_SCHEMAS:
        raise ValueError(f"more than {MAX_SCHEMAS} parameters")
    rows = [F.struct(F.lit(t).alias("tool"), F.lit(p).alias("param"), F.lit(kind).alias("kind"), F.lit(need).alias("need")) for t, ps in schemas.items() for p, (kind, need) in ps.items()]
    return F.array(*rows) if rows else F.expr("cast(array() as array<struct<tool:string,param:string,kind:string,need:boolean>>)")


#: Types of a parsed value by the schema's names.
KINDS = {"string": "STRING", "integer": r"(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))", "number": r"(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}


def _argument_errors(name: Column, arguments: Column, schemas) -> Column:
    """Errors of one call's arguments."""
    values = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    keys = F.array_sort(F.map_keys(values))
    known = F.filter(_registry(schemas), lambda s: s["tool"] == name)

    def of(s: Column) -> Column:
        found = F.schema_of_variant(F.element_at(values, s["param"]))
        typed = F.lit(False)
        for kind, pattern in KINDS.items():
            typed = F.when(s["kind"] == kind, found.rlike(f"^{pattern}$")).otherwise(typed)
        there = F.array_contains(keys, s["param"])
        return F.when(~there & s["need"], F.concat(F.lit("missing:"), s["param"])).when(there & ~F.coalesce(typed, F.lit(False)), F.concat(F.lit("type:"), s["param"]))

    listed = F.filter(F.transform(known, of), lambda e: e.isNotNull())
    extra = F.transform(F.filter(keys, lambda k: ~F.exists(known, lambda s: s["param"] == k)), lambda k: F.concat(F.lit("unexpected:"), k))
    return F.when(keys.isNull(), F.array(F.lit("bad_arguments"))).when(~F.coalesce(name, F.lit("")).isin(list(schemas)), F.array(F.lit("unknown_tool"))).otherwise(F.concat(listed, extra))


def format_chat(messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """conv_id, turn, role, order_turn, order_rank, n_calls, linked_turn, errors (sorted, comma-separated) and json of each message."""
    rows = messages.select("conv_id", "turn", F.lower(F.coalesce("role", F.lit("unknown"))).alias("role"), "text")
    is_json = F.col("text").rlike(r"^\s*\{")
    said = F.when((F.col("role") == "assistant") & is_json, F.from_json("text", CALLS))
    got = F.when((F.col("role") == "tool") & is_json, F.from_json("text", RESULT))
    rows = rows.withColumn("said", said).withColumn("got", got)
    rows = rows.select("conv_id", "turn", "role", "text", F.col("said.tool_calls").alias("calls"), F.col("said.content").alias("said_content"), F.col("got.tool_call_id").alias("call_id"), F.col("got.content").alias("got_content"))
    is_plain = F.coalesce(F.size("calls") <= 0, F.lit(True)) & F.col("call_id").isNull()
    plain = rows.filter(is_plain)
    rows = materialize(rows.filter(~is_plain).withColumn("text", F.lit(None).cast("string")))

    made = rows.filter(F.size("calls") > 0).select("conv_id", "turn", F.posexplode("calls").alias("nth", "c"))
    first = made.filter("c.id IS NOT NULL").groupBy("conv_id", F.col("c.id").alias("call_id")).agg(F.min(F.struct("turn", "nth")).alias("call_at"))
    answered = rows.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("turn").alias("answer_turn"))
    links = first.join(answered.hint("shuffle_hash"), ["conv_id", "call_id"], "left")

    # calls: their errors, summed up by message
    checked = made.withColumn("call_id", F.col("c.id")).join(links.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    own = _argument_errors(F.col("c.name"), F.col("c.arguments"), schemas)
    no_id = F.col("call_id").isNull()
    state = F.array_compact(F.array(F.when(no_id, F.lit("missing_id")), F.when(F.struct("turn", "nth") != F.col("call_at"), F.lit("duplicate_id")), F.when(~no_id & F.col("answer_turn").isNull(), F.lit("unanswered"))))
    checked = checked.select("conv_id", "turn", F.explode(F.concat(own, state)).alias("e")).groupBy("conv_id", "turn").agg(F.collect_set("e").alias("call_errors"))

    out = rows.join(links.select("conv_id", "call_id", F.col("call_at.turn").alias("call_turn")).hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    out = out.join(checked, ["conv_id", "turn"], "left").withColumn("call_errors", F.when(F.size("calls") > 0, F.col("call_errors"))).unionByName(plain, allowMissingColumns=True)
    is_result = F.col("call_id").isNotNull()
    mine = F.array_compact(F.array(F.when(is_result & F.col("call_turn").isNull(), F.lit("orphan_result")), F.when(is_result & (F.col("call_turn") >= F.col("turn")), F.lit("out_of_order"))))
    errors = F.array_join(F.array_sort(F.concat(F.coalesce("call_errors", F.expr("cast(array() as array<string>)")), mine)), ",")
    # only an object is parsed into the JSON: other values, and texts that are no JSON, are left out
    parsed = lambda c: F.when(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>").isNotNull(), F.try_parse_json(c))
    calls = F.transform("calls", lambda c: F.struct(parsed(c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    content = F.when(F.size("calls") > 0, F.col("said_content")).when(is_result, F.col("got_content")).otherwise(F.col("text"))
    json = F.to_json(F.struct(content.alias("content"), "conv_id", "role", F.col("call_id").alias("tool_call_id"), F.when(F.size("calls") > 0, calls).alias("tool_calls"), "turn"))
    after = is_result & F.col("call_turn").isNotNull()
    return out.select(
        "conv_id", "turn", "role", F.when(after, F.greatest("turn", "call_turn")).otherwise(F.col("turn")).alias("order_turn"), F.when(after, 1).otherwise(0).alias("order_rank"),
        F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0)).cast("long").alias("n_calls"), F.col("call_turn").alias("linked_turn"), errors.alias("errors"), json.alias("json"),
    )


_PARAMS = ", ".join(f"('{t}', '{p}', '{kind}', {need})" for t, ps in SCHEMAS.items() for p, (kind, need) in ps.items())

#: Links, checks and orders like the query; arguments are written with sorted keys on their first level (no object in the registry has more).
ORACLE_SQL = rf"""
WITH s(tool, param, kind, need) AS (VALUES {_PARAMS}),
m AS (SELECT row_number() OVER () AS k, conv_id, turn, lower(coalesce(role, 'unknown')) AS role, text, CASE WHEN regexp_matches(text, '^\s*\{{') AND json_valid(text) THEN text::JSON END AS j FROM conversations),
p AS (SELECT *, CASE WHEN role = 'assistant' AND json_type(j, '$.tool_calls') = 'ARRAY' THEN json_extract(j, '$.tool_calls[*]') ELSE [] END AS calls, CASE WHEN role = 'tool' THEN json_extract_string(j, '$.tool_call_id') END AS call_id FROM m),
c0 AS (SELECT k, conv_id, turn, unnest(range(0, len(calls))) AS nth, unnest(calls) AS c FROM p),
c1 AS (SELECT *, json_extract_string(c, '$.id') AS id, json_extract_string(c, '$.name') AS name, CASE WHEN json_type(c, '$.arguments') = 'VARCHAR' THEN json_extract_string(c, '$.arguments') ELSE json_extract(c, '$.arguments')::VARCHAR END AS a0 FROM c0),
c AS (SELECT *, CASE WHEN json_valid(a0) AND json_type(a0) = 'OBJECT' THEN a0::JSON END AS a FROM c1),
f AS (SELECT conv_id, id, min((turn, nth)) AS at FROM c WHERE id IS NOT NULL GROUP BY ALL),
r AS (SELECT DISTINCT conv_id, call_id FROM p WHERE call_id IS NOT NULL),
t AS (SELECT c.k, c.nth, param, need, kind, json_type(a, '$."' || param || '"') AS kt, list_contains(json_keys(a), param) AS there FROM c JOIN s ON s.tool = c.name WHERE a IS NOT NULL),
e AS (
  SELECT k, 'bad_arguments' AS e FROM c WHERE a IS NULL
  UNION SELECT k, 'unknown_tool' FROM c WHERE a IS NOT NULL AND coalesce(name, '') NOT IN (SELECT tool FROM s)
  UNION SELECT k, 'missing:' || param FROM t WHERE need AND NOT there
  UNION SELECT k, 'type:' || param FROM t WHERE there AND NOT coalesce(CASE kind WHEN 'string' THEN kt = 'VARCHAR' WHEN 'integer' THEN kt IN ('BIGINT', 'UBIGINT') WHEN 'boolean' THEN kt = 'BOOLEAN' END, false)
  UNION SELECT k, 'unexpected:' || u FROM (SELECT k, name, unnest(json_keys(a)) AS u FROM c WHERE a IS NOT NULL AND name IN (SELECT tool FROM s)) x WHERE NOT EXISTS (SELECT 1 FROM s WHERE tool = x.name AND param = x.u)
  UNION SELECT k, 'missing_id' FROM c WHERE id IS NULL
  UNION SELECT c.k, 'duplicate_id' FROM c JOIN f USING (conv_id, id) WHERE (c.turn, c.nth) <> f.at
  UNION SELECT c.k, 'unanswered' FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.id WHERE c.id IS NOT NULL AND r.call_id IS NULL
  UNION SELECT p.k, CASE WHEN f.id IS NULL THEN 'orphan_result' ELSE 'out_of_order' END FROM p LEFT JOIN f ON f.conv_id = p.conv_id AND f.id = p.call_id WHERE p.call_id IS NOT NULL AND (f.id IS NULL OR f.at[1] >= p.turn)),
es AS (SELECT k, string_agg(e, ',' ORDER BY e) AS errors FROM e GROUP BY k),
w AS (SELECT k, '[' || string_agg('{{' || concat_ws(',', CASE WHEN a IS NOT NULL THEN '"arguments":{{' || coalesce(list_aggregate(list_transform(list_sort(json_keys(a)), lambda x: to_json(x)::VARCHAR || ':' || json_extract(a, '$."' || x || '"')::VARCHAR), 'string_agg', ','), '') || '}}' END,
  CASE WHEN id IS NOT NULL THEN '"id":' || to_json(id)::VARCHAR END, CASE WHEN name IS NOT NULL THEN '"name":' || to_json(name)::VARCHAR END) || '}}', ',' ORDER BY nth) || ']' AS ws FROM c GROUP BY k),
o AS (SELECT p.*, f.at[1] AS call_turn, es.errors, w.ws, CASE WHEN len(calls) > 0 OR call_id IS NOT NULL THEN json_extract_string(j, '$.content') ELSE text END AS content
  FROM p LEFT JOIN f ON f.conv_id = p.conv_id AND f.id = p.call_id LEFT JOIN es USING (k) LEFT JOIN w USING (k))
SELECT conv_id, turn, role, CASE WHEN call_turn IS NOT NULL THEN greatest(turn, call_turn) ELSE turn END AS order_turn, (call_turn IS NOT NULL)::INT AS order_rank, len(calls)::BIGINT AS n_calls, call_turn AS linked_turn, coalesce(errors, '') AS errors,
  '{{' || concat_ws(',', CASE WHEN content IS NOT NULL THEN '"content":' || to_json(content)::VARCHAR END, CASE WHEN conv_id IS NOT NULL THEN '"conv_id":' || conv_id END, '"role":' || to_json(role)::VARCHAR, CASE WHEN call_id IS NOT NULL THEN '"tool_call_id":' || to_json(call_id)::VARCHAR END,
  CASE WHEN ws IS NOT NULL THEN '"tool_calls":' || ws END, CASE WHEN turn IS NOT NULL THEN '"turn":' || turn END) || '}}' AS json FROM o
"""
