"""Chat formatting with tool-call linking.

A message's text may be plain, or a JSON object that carries tools:

- {"tools": [{"name": ..., "parameters": JSON schema}]} declares tools for its conversation (any role);
- {"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": object or JSON text}]} calls them (assistant);
- {"tool_call_id": ..., "content": ...} is a result (tool).

Calls and results are exploded and hash-joined on (conv_id, identifier) in Spark, and calls joined to the declared schema
on (conv_id, name). Within a conversation the messages are put in topological order: a result after its call, a call
after the results that its arguments refer to as {"$ref": identifier}, otherwise by turn. Arguments are
validated against the schema (type, enum, const, anyOf, oneOf, allOf, not, required, properties, additionalProperties, items,
minItems, maxItems, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern). Each conversation is serialised as canonical JSON: keys sorted, no spaces, no escapes but needed.

Defined results: rows of a null conv_id are left out; messages of a null turn come last; a null role or text is null in the JSON.
Rows repeated in full count once; of several calls of one identifier the first by turn is linked, the others are invalid.
Text that isn't a JSON object of these shapes is plain. A malformed schema makes its calls invalid. Arguments that aren't JSON, hold NaN, Infinity or a
number beyond doubles, or are nested deeper than DEPTH, stay text and make the call invalid; halves of surrogate pairs are replaced. A result without a call stays, and is counted as unlinked; so is
a call without a result. A call is invalid if its tool isn't declared though others are, or its arguments fail. Cycles of references
are cut at the earliest turn and counted as invalid. A conversation is one task's work, its messages in memory.
Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import json
import math
import operator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "conv_id long, n_messages long, n_calls long, n_linked long, n_unlinked long, n_invalid long, messages string"
#: Levels of nesting beyond which JSON text isn't read as JSON; seconds that a schema's pattern may take for one text.
DEPTH, PATTERN_S = 200, 2.0
_CALL = "array<struct<id:string,name:string,arguments:string>>"


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # halves of characters: those that meet are joined, others replaced
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def _number(text: str) -> float:
    if not math.isfinite(value := float(text)):
        raise ValueError(text)
    return value


def _load(text):
    """The value of JSON text; None where it isn't JSON (NaN and Infinity aren't), has a number that no double holds, or is nested deeper than DEPTH."""
    try:
        value = json.loads(text, parse_constant=_number, parse_float=_number)
    except (ValueError, TypeError, RecursionError):
        return None
    level, depth = [value], 0
    while level := [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]:
        if (depth := depth + 1) >= DEPTH:
            return None
    return value


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _numeric(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _is_a(value, kind) -> bool:
    if kind in ("number", "integer"):
        return _numeric(value) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS[kind]) if kind in _KINDS else True


def _limits(value, schema: dict, at: str) -> list[str]:
    """Checks that look at one value alone; a keyword whose own value makes no sense is an error too."""
    out = []

    def bound(key: str, measure, broken, said: str, real: bool = False) -> None:
        if key in schema:
            limit = schema[key]
            if not _numeric(limit) or not real and (limit < 0 or limit != int(limit)):
                out.append(f"{at}: malformed {key} in the schema")
            elif broken(measure, limit):
                out.append(f"{at}: {said}")

    if _numeric(value):
        bound("minimum", value, operator.lt, "below the minimum", True)
        bound("maximum", value, operator.gt, "above the maximum", True)
        bound("exclusiveMinimum", value, operator.le, "not above the exclusive minimum", True)
        bound("exclusiveMaximum", value, operator.ge, "not below the exclusive maximum", True)
    if isinstance(value, str):
        bound("minLength", len(value), operator.lt, "too short")
        bound("maxLength", len(value), operator.gt, "too long")
        if "pattern" in schema:
            try:
                if not regex.search(schema["pattern"], value, timeout=PATTERN_S):
                    out.append(f"{at}: doesn't match the pattern")
            except (regex.error, TypeError, TimeoutError):
                out.append(f"{at}: malformed pattern in the schema")
    if isinstance(value, list):
        bound("minItems", len(value), operator.lt, "too few items")
        bound("maxItems", len(value), operator.gt, "too many items")
    return out


def violations(value, schema, at: str = "$") -> list[str]:
    """What in ``value`` breaks the schema; an unknown keyword is no constraint, and a malformed one is a violation. Neither is nested deeper than DEPTH (see ``_load``)."""
    if schema is True:
        return []
    if not isinstance(schema, dict):
        return [f"{at}: nothing is allowed"] if schema is False else [f"{at}: malformed schema"]
    wanted = schema.get("type", [])
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if not isinstance(wanted, list) or not all(isinstance(k, str) for k in wanted):
        return [f"{at}: malformed type in the schema"]
    if wanted and not any(_is_a(value, k) for k in wanted):
        return [f"{at}: not of type {wanted[0] if len(wanted) == 1 else wanted}"]
    out = []
    if "enum" in schema:
        if not isinstance(schema["enum"], list):
            out.append(f"{at}: malformed enum in the schema")
        elif canonical(value) not in {canonical(x) for x in schema["enum"]}:
            out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    for key, fits in (("anyOf", lambda n, of: n > 0), ("oneOf", lambda n, of: n == 1), ("allOf", lambda n, of: n == of)):
        if key in schema:
            if not isinstance(schema[key], list) or not schema[key]:
                out.append(f"{at}: malformed {key} in the schema")
            elif not fits(sum(not violations(value, x, at) for x in schema[key]), len(schema[key])):
                out.append(f"{at}: doesn't fit {key}")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: fits not")
    out += _limits(value, schema, at)
    if isinstance(value, dict):
        known, required = schema.get("properties", {}), schema.get("required", [])
        if not isinstance(known, dict):
            out.append(f"{at}: malformed properties in the schema")
            known = {}
        if not isinstance(required, list) or not all(isinstance(k, str) for k in required):
            out.append(f"{at}: malformed required in the schema")
            required = []
        out += [f"{at}.{k}: missing" for k in required if k not in value]
        for k, v in value.items():
            out += violations(v, known[k] if k in known else schema.get("additionalProperties", True), f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{k}]")
    return out


def references(value) -> list[str]:
    found, left = [], [value]
    while left:
        x = left.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                found.append(x["$ref"])
            left += x.values()
        elif isinstance(x, list):
            left += x
    return found


def topological(after: list[set[int]]) -> tuple[list[int], int]:
    """Kahn's order of 0..n-1, the least first of those ready; how many cycles were cut (at the least left)."""
    import heapq

    n, before, missing, cut = len(after), [[] for _ in after], [len(a) for a in after], 0
    for i, a in enumerate(after):
        for j in a:
            before[j].append(i)
    ready, done, order = [i for i in range(n) if not missing[i]], [False] * n, []
    heapq.heapify(ready)
    least = 0
    while len(order) < n:
        if not ready:
            while done[least]:
                least += 1
            heapq.heappush(ready, least)
            cut += 1
        i = heapq.heappop(ready)
        if done[i]:
            continue
        done[i] = True
        order.append(i)
        for j in before[i]:
            missing[j] -= 1
            if not missing[j] and not done[j]:
                heapq.heappush(ready, j)
    return order, cut


def conversation(conv_id: int, rows: list[dict], calls: list[dict]) -> dict:
    """One row of the result from a conversation's messages, and their joined calls and results by message."""
    made = {c["m"]: c["calls"] for c in calls}
    rows = [r | {"calls": made.get(r["m"], [] if r["calling"] else None)} for r in {r["m"]: r for r in rows}.values()]
    rows = sorted(rows, key=lambda r: (r["turn"] is None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    made_at: dict[str, int] = {}
    result_at: dict[str, list[int]] = {}
    n_calls = n_linked = n_unlinked = n_invalid = 0
    messages: list[dict] = []
    after: list[set[int]] = [set() for _ in rows]
    for k, r in enumerate(rows):
        for c in r["calls"] or []:
            if c["id"] is not None:
                made_at.setdefault(c["id"], k)
        if r["result_of"] is not None:
            result_at.setdefault(r["result_of"], []).append(k)
    seen: set[str] = set()
    for k, r in enumerate(rows):
        message = {"content": r["content"], "role": r["role"]}
        if r["calls"]:
            message["tool_calls"] = []
            for c in r["calls"]:
                n_calls += 1
                arguments = _load(c["arguments"]) if c["arguments"] is not None else {}
                if arguments is None and c["arguments"] != "null":
                    arguments = c["arguments"]  # its text
                    errors = ["$: not JSON"]
                else:
                    errors = []
                entry = {"arguments": arguments, "id": c["id"], "name": c["name"], "result": c["result"]}
                if c["id"] is None or c["id"] in seen:
                    errors.append("$: identifier missing or repeated")
                elif c["linked"]:
                    n_linked += 1
                else:
                    n_unlinked += 1
                seen.add(c["id"])
                if c["schema"] is not None:
                    errors += violations(arguments, _load(c["schema"])) if not errors else []
                elif c["declared"]:
                    errors.append("$: tool not declared")
                if errors:
                    entry["errors"] = errors
                    n_invalid += 1
                for ref in references(arguments):
                    after[k] |= {j for j in result_at.get(ref, []) if j != k}
                message["tool_calls"].append(entry)
        if r["result_of"] is not None:
            message["tool_call_id"] = r["result_of"]
            if (j := made_at.get(r["result_of"])) is None:
                n_unlinked += 1
            elif j != k:
                after[k].add(j)
        messages.append(message)
    order, cut = topological(after)
    text = canonical({"conv_id": conv_id, "messages": [messages[k] for k in order]})
    return {"conv_id": conv_id, "n_messages": len(rows), "n_calls": n_calls, "n_linked": n_linked, "n_unlinked": n_unlinked, "n_invalid": n_invalid + cut, "messages": text}


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation: counts, and the canonical JSON."""
    raw = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")).where("conv_id is not null")
    # within its conversation a message goes by a hash, so that texts are shuffled once and no join carries them
    raw = raw.withColumn("m", F.xxhash64("turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text"))
    # only text that can be an object is parsed
    parsed = raw.withColumn("doc", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    calls = F.try_variant_get("doc", "$.tool_calls", "array<variant>")
    as_text = lambda v, p: F.try_variant_get(v, p, "string")
    held = F.transform(calls, lambda c: F.struct(as_text(c, "$.id").alias("id"), F.coalesce(as_text(c, "$.name"), as_text(c, "$.function.name")).alias("name"), F.coalesce(as_text(c, "$.arguments"), as_text(c, "$.function.arguments")).alias("arguments")))
    shaped = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)) & (calls.isNotNull() | as_text("doc", "$.tool_call_id").isNotNull())
    content = F.when(shaped, as_text("doc", "$.content")).otherwise(F.col("text"))
    rows = parsed.select(
        "conv_id", "turn", "role", "text", "m", content.alias("content"), F.when(shaped, held).cast(_CALL).alias("calls"), F.when(shaped & calls.isNull(), as_text("doc", "$.tool_call_id")).alias("result_of"),
        F.try_variant_get("doc", "$.tools", "array<variant>").alias("tools"),
    )
    objects = rows.where(F.ltrim("text").startswith("{"))
    late = F.col("turn").isNull()  # null turns come last
    one = objects.select("conv_id", "m", F.posexplode("calls").alias("nth", "call")).select("conv_id", "m", "nth", "call.*").distinct()
    results = objects.where("result_of is not null").groupBy("conv_id", F.col("result_of").alias("id")).agg(F.min_by("content", F.struct(late, "turn", "text")).alias("result"), F.lit(True).alias("linked"))
    tools = objects.select("conv_id", "turn", F.explode("tools").alias("tool")).select("conv_id", "turn", as_text("tool", "$.name").alias("name"), as_text("tool", "$.parameters").alias("schema"))
    tools = tools.where("name is not null").groupBy("conv_id", "name").agg(F.max_by("schema", F.struct(late, "turn", "schema")).alias("schema"))
    declared = tools.select("conv_id").distinct().withColumn("declared", F.lit(True))
    linked = one.join(results, ["conv_id", "id"], "left").join(tools, ["conv_id", "name"], "left").join(declared, "conv_id", "left")
    call = F.struct("nth", "id", "name", "arguments", "result", F.coalesce("linked", F.lit(False)).alias("linked"), "schema", F.coalesce("declared", F.lit(False)).alias("declared"))
    back = linked.groupBy("conv_id", "m").agg(F.array_sort(F.collect_list(call)).alias("calls")).select("conv_id", F.struct("m", "calls").alias("called"))
    message = F.struct("m", "turn", "role", "text", "content", "result_of", F.col("calls").isNotNull().alias("calling")).alias("message")
    both = rows.select("conv_id", message).unionByName(back, allowMissingColumns=True)
    grouped = both.groupBy("conv_id").agg(F.collect_list("message").alias("messages"), F.collect_list("called").alias("calls"))

    def run(batches):
        for batch in batches:
            made = [conversation(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], pa.string() if n == "messages" else pa.int64()) for n in names], names)

    return grouped.mapInArrow(run, SCHEMA)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Conversations with tool calls, for the query of that name: (conv_id, turn, role, text).
_TOOLS = '{"tools": [{"name": "add", "parameters": {"type": "object", "required": ["x"], "additionalProperties": false, "properties": {"x": {"type": "integer", "minimum": 0}}}}]}'
FIXTURE = tuple(
    (c, turn, role, text)
    for c in range(1, 41)
    for turn, role, text in (
        (0, "system", _TOOLS),
        (1, "user", f"please add {c}"),
        (3, "assistant", f'{{"content": "sum", "tool_calls": [{{"id": "a{c}", "name": "add", "arguments": {{"x": {c - 10}}}}}]}}'),  # invalid below 0
        *(((2, "tool", f'{{"tool_call_id": "a{c}", "content": "{c}"}}'),) if c % 3 else ()),  # before its call; a third have none
        *(((4, "assistant", f'{{"content": "", "tool_calls": [{{"id": "b{c}", "name": "sub", "arguments": {{}}}}]}}'),) if c % 5 == 0 else ()),  # not declared
        *(((5, "tool", f'{{"tool_call_id": "lost{c}", "content": ""}}'),) if c % 7 == 0 else ()),  # of no call
    )
)


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``formatted`` over FIXTURE: counts, and whether the result stands behind its call."""
    got = formatted(spark.createDataFrame(FIXTURE, "conv_id long, turn long, role string, text string"))
    place = [F.call_function("locate", F.concat(F.lit(f'"{key}":"a'), F.col("conv_id"), F.lit('"')), F.col("messages")) for key in ("tool_call_id", "id")]
    return got.select("conv_id", "n_messages", "n_calls", "n_linked", "n_unlinked", "n_invalid", ((place[0] == 0) | (place[0] > place[1])).alias("in_order"))


def tool_calls_sql() -> str:
    """DuckDB SQL of ``chat_tool_calls``: calls, results and tools joined by identifier and name, arguments checked as FIXTURE's schema says."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({c}, {turn}, {quote(role)}, {quote(text)})" for c, turn, role, text in FIXTURE)
    return f"""
WITH m(conv_id, turn, role, text) AS (VALUES {values}),
doc AS (SELECT *, CASE WHEN text LIKE '{{%' THEN CAST(text AS JSON) END AS d FROM m),
calls AS (SELECT conv_id, json_extract_string(c, '$.id') AS id, json_extract_string(c, '$.name') AS name, json_extract(c, '$.arguments') AS a
  FROM (SELECT conv_id, unnest(from_json(json_extract(d, '$.tool_calls'), '["json"]')) AS c FROM doc WHERE json_extract(d, '$.tool_calls') IS NOT NULL)),
results AS (SELECT conv_id, json_extract_string(d, '$.tool_call_id') AS id FROM doc WHERE json_extract_string(d, '$.tool_call_id') IS NOT NULL),
tools AS (SELECT conv_id, json_extract_string(t, '$.name') AS name FROM (SELECT conv_id, unnest(from_json(json_extract(d, '$.tools'), '["json"]')) AS t FROM doc WHERE json_extract(d, '$.tools') IS NOT NULL)),
checked AS (SELECT c.conv_id, r.id IS NOT NULL AS linked, t.name IS NULL OR coalesce(json_type(c.a, '$.x') NOT IN ('BIGINT', 'UBIGINT'), TRUE) OR CAST(json_extract(c.a, '$.x') AS BIGINT) < 0 AS bad
  FROM calls c LEFT JOIN results r ON r.conv_id = c.conv_id AND r.id = c.id LEFT JOIN tools t ON t.conv_id = c.conv_id AND t.name = c.name),
lost AS (SELECT r.conv_id, count(*) AS n FROM results r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.id = r.id WHERE c.id IS NULL GROUP BY 1)
SELECT m.conv_id::BIGINT AS conv_id, m.n AS n_messages, k.n AS n_calls, k.linked AS n_linked, k.n - k.linked + coalesce(l.n, 0) AS n_unlinked, k.bad AS n_invalid, TRUE AS in_order
FROM (SELECT conv_id, count(*) AS n FROM m GROUP BY 1) m JOIN (SELECT conv_id, count(*) AS n, count(*) FILTER (linked) AS linked, count(*) FILTER (bad) AS bad FROM checked GROUP BY 1) k ON k.conv_id = m.conv_id LEFT JOIN lost l ON l.conv_id = m.conv_id
"""


def sql(conversations: str = "conversations") -> str:
    """DuckDB SQL of ``formatted`` for conversations of plain messages alone, as those of the test tables are."""
    return f"""
WITH m AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM {conversations} WHERE conv_id IS NOT NULL)
SELECT conv_id, count(*) AS n_messages, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_unlinked, CAST(0 AS BIGINT) AS n_invalid,
  '{{"conv_id":' || conv_id || ',"messages":[' || string_agg('{{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}}', ',' ORDER BY turn NULLS LAST, role, text) || ']}}' AS messages
FROM m GROUP BY conv_id
"""
