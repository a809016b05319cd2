"""Chat formatting with tool-call linking.

Input rows are messages (conv_id, turn, role, text). A message calls tools with ``<tool_call>{"id", "name", "arguments"}
</tool_call>`` blocks; a message of role ``tool`` is a result, JSON with ``tool_call_id`` and ``content``; a message of any
role may declare tools with a ``<tools>[{"name", "parameters": JSON schema}]</tools>`` block, which hold for its
conversation. Arguments that mention ``${id}`` need the result of the call ``id``.

Calls and results are joined by (conv_id, id). Calls are ordered topologically: a call's level is one more than the highest
level it needs, found by repeated joins, one for each level. A result never comes before its call: its effective turn is at
least the call's. Arguments are validated against the declared schema (``KEYWORDS`` and type); ``valid`` is null where that
hangs on another keyword or on a schema that cannot be read. Every message is returned as canonical JSON (sorted keys, no
spaces, UTF-8) with its place in its conversation.

Messages keep their turns but for results that come before their call; the order of calls within a message is that of their
levels. Places are counted in ranges of all messages, so no task gets a whole long conversation. Defined results: null text is
an empty content, null role and conv_id stay null, a call without an id or with broken JSON is left in the text and counted in
n_broken, one whose arguments cannot be read also in n_invalid, as is one whose arguments do not fit; JSON that is nested beyond
``DEPTH`` or holds a number that no double can is broken; a result of broken JSON is plain content; half a surrogate pair stays an
escape. Of several results (or calls) of one id in a conversation all link with the first call by turn, results without a call
are ``unlinked``, calls in a cycle get level -1; ties and repeated rows keep an arbitrary but complete order.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import batch, discard, materialize

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
TOOLS = r"(?s)<tools>(.*?)</tools>"
NEEDS = r"\$\{([A-Za-z0-9_.-]+)\}"

#: Nesting that arguments, results and schemas may have.
DEPTH = 100
TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: Keywords that only describe.
NOTES = frozenset("title description default examples format deprecated readOnly writeOnly $schema $id $comment".split())
SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(x) -> str:
    """JSON with sorted keys and no spaces, of whole characters: half a surrogate pair stays an escape."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(text)
    return x


def parsed(text: str):
    """The JSON value of a text; ValueError if it is none, holds a number that no double can, or is nested beyond DEPTH."""
    try:
        out = json.loads(text, parse_float=finite, parse_constant=finite)
    except RecursionError as error:
        raise ValueError("nested too deeply") from error
    level = [out]
    for _ in range(DEPTH):
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return out
    raise ValueError("nested too deeply")


def number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def equal(x, y) -> bool:
    return x == y if number(x) and number(y) else canonical(x) == canonical(y)


def is_a(x, kind) -> bool:
    if kind == "number":
        return number(x)
    if kind == "integer":
        return number(x) and (isinstance(x, int) or x.is_integer())
    return isinstance(x, TYPES[kind])


def together(found) -> bool | None:
    """False if any is, else None if any is, else True."""
    found = list(found)
    return False if False in found else None if None in found else True


def opposite(found: bool | None) -> bool | None:
    return None if found is None else not found


def exactly_one(found: list[bool | None]) -> bool | None:
    if None in found:
        return False if found.count(True) > 1 else None
    return found.count(True) == 1


def listed(value) -> list:
    return value if isinstance(value, list) else []


def named(schema: dict) -> dict:
    """The properties that a schema names; none if that keyword is no object."""
    found = schema.get("properties")
    return found if isinstance(found, dict) else {}


#: What a keyword of a schema asks of a value: (x, the keyword's value, the schema) -> bool, None if it cannot be told, as by a
#: keyword whose own value is of the wrong type; null counts as absent.
KEYWORDS = {
    "enum": lambda x, v, _: any(equal(x, e) for e in v) if isinstance(v, list) else None,
    "const": lambda x, v, _: equal(x, v),
    "minimum": lambda x, v, _: not number(x) or (x >= v if number(v) else None),
    "maximum": lambda x, v, _: not number(x) or (x <= v if number(v) else None),
    "exclusiveMinimum": lambda x, v, _: not number(x) or (x > v if number(v) else None),
    "exclusiveMaximum": lambda x, v, _: not number(x) or (x < v if number(v) else None),
    "minLength": lambda x, v, _: not isinstance(x, str) or (len(x) >= v if number(v) else None),
    "maxLength": lambda x, v, _: not isinstance(x, str) or (len(x) <= v if number(v) else None),
    "minItems": lambda x, v, _: not isinstance(x, list) or (len(x) >= v if number(v) else None),
    "maxItems": lambda x, v, _: not isinstance(x, list) or (len(x) <= v if number(v) else None),
    "required": lambda x, v, _: not isinstance(x, dict) or (all(k in x for k in v if isinstance(k, str)) if isinstance(v, list) else None),
    "properties": lambda x, v, _: not isinstance(x, dict) or (together(valid(x[k], v[k]) for k in v if k in x) if isinstance(v, dict) else None),
    "additionalProperties": lambda x, v, s: together(valid(y, v) for k, y in x.items() if k not in named(s)) if isinstance(x, dict) else True,
    "items": lambda x, v, _: together(valid(y, v) for y in x) if isinstance(x, list) and not isinstance(v, list) else True if not isinstance(x, list) else None,
    "allOf": lambda x, v, _: together(valid(x, s) for s in v) if isinstance(v, list) else None,
    "anyOf": lambda x, v, _: opposite(together(opposite(valid(x, s)) for s in v)) if isinstance(v, list) else None,
    "oneOf": lambda x, v, _: exactly_one([valid(x, s) for s in v]) if isinstance(v, list) else None,
    "not": lambda x, v, _: opposite(valid(x, v)),
}


def valid(x, schema) -> bool | None:
    """Whether x fits a JSON schema; None if that hangs on a keyword that is not supported (pattern, $ref and others)."""
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        return True
    found: list[bool | None] = []
    for word, value in schema.items():
        if value is None and word != "const":
            continue  # as if it were not there
        if word == "type":
            kinds = [k for k in ([value] if isinstance(value, str) else listed(value)) if isinstance(k, str)]
            known = [k for k in kinds if k in TYPES or k in ("number", "integer")]
            found.append(not kinds or any(is_a(x, k) for k in known) or (None if len(known) < len(kinds) else False))
        elif word in KEYWORDS:
            found.append(KEYWORDS[word](x, value, schema))
        elif word not in NOTES:
            found.append(None)
    return together(found)


def calls_of(messages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, k, id, name, raw): every well-formed call block."""
    blocks = messages.where(F.col("text").contains("<tool_call>")).select("row", "conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("k", "raw"))
    read = blocks.select("*", F.get_json_object("raw", "$.id").alias("id"), F.get_json_object("raw", "$.name").alias("name"))
    return read.where("id is not null and name is not null")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level): 0 for a call that needs no other, -1 for calls of a cycle and those that need them."""
    nodes = calls.groupBy("conv_id", "id").agg(F.flatten(F.collect_list(F.regexp_extract_all("raw", F.lit(NEEDS), F.lit(1)))).alias("needs"))
    nodes = materialize(nodes, "calls")
    edges = nodes.select("conv_id", "id", F.explode(F.array_distinct("needs")).alias("need"))
    have = nodes.select("conv_id", F.col("id").alias("need"))
    edges = materialize(edges.join(have, ["conv_id", "need"]), "needs")
    done = materialize(nodes.join(edges, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).alias("level")), "levels")
    while True:
        known = edges.join(done.select("conv_id", F.col("id").alias("need"), "level"), ["conv_id", "need"], "left")
        ready = known.groupBy("conv_id", "id").agg(F.max("level").alias("top"), F.count("level").alias("n"), F.count("*").alias("all")).where("n = all")
        new = materialize(ready.join(done, ["conv_id", "id"], "left_anti").select("conv_id", "id", (F.col("top") + 1).alias("level")), "levels")
        if not new.limit(1).count():
            break
        more = materialize(done.unionByName(new), "levels")
        discard(done, new)
        done = more
    return nodes.select("conv_id", "id").join(done, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("level", F.lit(-1)).alias("level"))


def places(messages: DataFrame) -> DataFrame:
    """messages with their position in their conversation, by at, late, turn, role and text.

    Messages are dealt out by ranges of that order, so that neither a long conversation nor a turn of very many messages is
    one task; a position is the number within the range's part of the conversation and the sizes of the parts before it.
    """
    order = ["conv_id", "at", "late", "turn", "role", "text", "tie"]
    # equal messages of different tasks may part
    ranged = messages.withColumn("tie", F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n"))
    # fewer than there are ranges: a conversation that goes on from the range before
    on = F.broadcast(before.where("before > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before"))
    rank = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order[1:])) - 1
    placed = ranged.withColumn("k", rank).join(on, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return placed.withColumn("position", F.coalesce("before", F.lit(0)) + F.col("k"))


def format_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, position, message, n_calls, n_invalid, n_broken, link of every row of conversations.

    link: for a result ``linked`` or ``unlinked``, otherwise ``none``.
    """
    plain = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))
    calls = materialize(calls_of(plain), "calls")
    has_calls = calls.limit(1).count() > 0
    out = plain.withColumn("id", F.when(F.col("role") == "tool", F.get_json_object("text", "$.tool_call_id")))
    if has_calls:
        # of equal rows one gives the calls; of several calls of one id the first by turn is the one that results link with
        calls = calls.dropDuplicates(["row", "k"])
        first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "k", "name")).alias("call"))
        schemas = plain.where(F.col("text").contains("<tools>")).select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(TOOLS), F.lit(1))).alias("raw"))
        tools = schemas.select("conv_id", "turn", F.explode(F.from_json("raw", "array<string>")).alias("tool"))
        tools = tools.select("conv_id", "turn", F.get_json_object("tool", "$.name").alias("name"), F.get_json_object("tool", "$.parameters").alias("schema"))
        tools = tools.where("name is not null").groupBy("conv_id", "name").agg(F.min_by("schema", F.struct("turn", "schema")).alias("schema"))
        own = calls.join(levels(calls), ["conv_id", "id"], "left").join(tools, ["conv_id", "name"], "left")
        per = own.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("level", "k", "id", "name", "raw", "schema"))).alias("calls"))
        out = out.join(per, "row", "left").join(first, ["conv_id", "id"], "left")
    else:
        out = out.withColumns({"calls": F.lit(None).cast("array<struct<level:int,k:int,id:string,name:string,raw:string,schema:string>>"), "call": F.lit(None).cast("struct<turn:long,k:int,name:string>")})
    out = out.withColumn("at", F.greatest("turn", "call.turn")).withColumn("late", (F.col("at") > F.col("turn")) | ((F.col("role") == "tool") & (F.col("turn") == F.col("call.turn"))))
    out = out.select("conv_id", "turn", "role", "text", "id", "calls", F.col("call.name").alias("called"), "at", F.coalesce("late", F.lit(False)).alias("late"))
    placed = places(out).select("conv_id", "turn", "position", "role", "text", "id", "called", "calls")
    arrow = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("message", pa.string()), ("n_calls", pa.int64()), ("n_invalid", pa.int64()), ("n_broken", pa.int64()), ("link", pa.string())])

    def run(batches):
        for b in batches:
            messages, n_calls, n_invalid, n_broken, links = [], [], [], [], []
            for role, text, id_, called, calls in zip(*(b.column(k).to_pylist() for k in range(3, 8)), strict=True):
                message, made, wrong, link = {"content": text, "role": role}, [], 0, "none"
                for c in calls or []:
                    try:
                        arguments = parsed(c["raw"]).get("arguments")
                        arguments = parsed(arguments) if isinstance(arguments, str) else arguments
                    except (ValueError, AttributeError):
                        wrong += 1
                        continue
                    try:
                        schema = parsed(c["schema"]) if c["schema"] else None
                    except ValueError:
                        schema = {"unread": None}  # so that nothing is told of the arguments
                    fits = valid({} if arguments is None else arguments, schema)
                    made.append({"arguments": {} if arguments is None else arguments, "id": c["id"], "level": c["level"], "name": c["name"], "valid": fits})
                    wrong += fits is False
                    text = text.replace(f"<tool_call>{c['raw']}</tool_call>", "", 1)
                if made:
                    message |= {"content": text.strip(), "tool_calls": made}
                if role == "tool":
                    link = "linked" if called is not None else "unlinked"
                    try:
                        body = parsed(text)
                    except ValueError:
                        body = None
                    if isinstance(body, dict) and id_ is not None:
                        message = {"content": body.get("content"), "name": called, "role": role, "tool_call_id": id_}
                messages.append(canonical(message))
                n_calls.append(len(made))
                n_invalid.append(wrong)
                n_broken.append(text.count("<tool_call>"))
                links.append(link)
            yield batch(arrow, b.column(0), b.column(1), b.column(2), messages, n_calls, n_invalid, n_broken, links)

    return placed.mapInArrow(run, "conv_id long, turn long, position long, message string, n_calls long, n_invalid long, n_broken long, link string")
