"""Tool calls in conversations: results linked by identifier, calls in topological order, arguments validated, canonical JSON.

Calls and results meet in a hash join on (conversation, identifier), so a conversation of any length is spread over all tasks. A call may name calls
that it comes after. Its level is the length of the longest such chain. A conversation with up to HELD of these links is levelled in one task. In a larger one,
chains of single predecessors are shortened by pointer doubling, in as many rounds as their length has binary digits; calls with several
predecessors are resolved as soon as all of these are. Sorting by (level, turn, place) is a topological order. Calls on a cycle, or after one, have no level.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.frames import settle, slices

#: Links of a conversation that one task may hold.
HELD = 100_000
MARKS = {"call": ("<tool_call>", "</tool_call>"), "result": ("<tool_result>", "</tool_result>")}
PARTS = "kind string, conv_id long, turn long, place int, id string, name string, arguments string, after array<string>, content string, broken boolean"
_ARROW = pa.schema(
    [("kind", pa.string()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("after", pa.list_(pa.string())), ("content", pa.string()), ("broken", pa.bool_())]
)
#: What goes wrong with values that are no JSON, whatever the reader accepted: other numbers, lone surrogates, too deep a nesting, too many digits.
WRONG = (ValueError, RecursionError)


def _sound(text: object) -> bool:
    """Whether it is a text that UTF-8 can write."""
    return isinstance(text, str) and not re.search("[\ud800-\udfff]", text)


def canonical(value: object) -> str:
    """One text for equal JSON values: keys by UTF-16 code units, no spaces, whole floats as integers, shortest form of others.

    One of WRONG for a value that is none of JSON's: not a number, infinite, with a lone surrogate, or nested too deeply.
    """
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("JSON has no such number")
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, str) and not _sound(value):
        raise ValueError("a surrogate stands alone")
    return json.dumps(value, ensure_ascii=False)


def _is(value: object, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "number": number, "boolean": isinstance(value, bool), "null": value is None,
        "integer": number and float(value).is_integer() if number and abs(value) < 1e300 else False,
    }.get(kind, False)


def violations(value: object, schema: dict, path: str = "$") -> list[str]:
    """What in a value breaks a JSON schema, as path and keyword. Keywords: type, enum, required, properties, additionalProperties, items, minItems, maxItems, minLength, maxLength, pattern, minimum, maximum."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}:type"]
    out = []
    if "enum" in schema and not any(canonical(value) == canonical(e) for e in schema["enum"]):
        out.append(f"{path}:enum")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{path}.{k}:required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in own:
                out += violations(v, own[k], f"{path}.{k}")
            elif (more := schema.get("additionalProperties", True)) is False:
                out.append(f"{path}.{k}:additionalProperties")
            elif isinstance(more, dict):
                out += violations(v, more, f"{path}.{k}")
    elif isinstance(value, list):
        out += [f"{path}:minItems"] * (len(value) < schema.get("minItems", 0)) + [f"{path}:maxItems"] * (len(value) > schema.get("maxItems", len(value)))
        for i, v in enumerate(value):
            out += violations(v, schema.get("items", {}), f"{path}[{i}]")
    elif isinstance(value, str):
        out += [f"{path}:minLength"] * (len(value) < schema.get("minLength", 0)) + [f"{path}:maxLength"] * (len(value) > schema.get("maxLength", len(value)))
        out += [f"{path}:pattern"] * ("pattern" in schema and not re.search(schema["pattern"], value))
    elif _is(value, "number"):
        out += [f"{path}:minimum"] * ("minimum" in schema and value < schema["minimum"]) + [f"{path}:maximum"] * ("maximum" in schema and value > schema["maximum"])
    return out


def marked(text: str) -> Iterator[tuple[str, str]]:
    """(kind, what is between the marks) in the order of the text. A mark that is not closed is none; what a pair of marks encloses is not searched for others."""
    at, last = 0, {kind: text.rfind(close) for kind, (_, close) in MARKS.items()}
    next_ = {kind: text.find(open_) for kind, (open_, _) in MARKS.items()}
    while True:
        for kind, (open_, _) in MARKS.items():
            if 0 <= next_[kind] < at:
                next_[kind] = text.find(open_, at)
        # A kind without a closing mark further on has no more parts, so no place is searched twice.
        open_kinds = [(place, kind) for kind, place in next_.items() if place >= 0 and last[kind] >= place + len(MARKS[kind][0])]
        if not open_kinds:
            return
        place, kind = min(open_kinds)
        start = place + len(MARKS[kind][0])
        end = text.find(MARKS[kind][1], start)
        yield kind, text[start:end]
        at = end + len(MARKS[kind][1])


def marked_parts(turn: int | None, role: str | None, text: str) -> Iterator[tuple]:
    """Calls and results that stand in a turn's text as marked JSON objects: (kind, id, name, arguments, after, content, broken), in the order of the text.

    Broken JSON gives a broken call or result without id; its text is the call's arguments. An id, a name or a predecessor that is no text that UTF-8 can write
    is missing. A content that is no JSON value is missing and the result broken.
    """
    for kind, body in marked(text):
        broken = False
        try:
            found = json.loads(body)
            if not isinstance(found, dict):
                found, broken = {}, True
        except WRONG:
            found, broken = {}, True
        after = found.get("after")
        arguments = body if broken else None
        content = None
        try:
            arguments = arguments if broken else json.dumps(found.get("arguments"))
            content = canonical(found["content"]) if "content" in found else None
        except WRONG:
            broken = True
        own, name = (found.get(x) if _sound(found.get(x)) else None for x in ("id", "name"))
        yield kind, own, name, arguments if arguments is not None else body, [a for a in after if _sound(a)] if isinstance(after, list) else [], content, broken


def turn_parts(turn: int | None, role: str | None, text: str) -> Iterator[tuple]:
    """A dialogue without marks: each question is a call to answer it, known by its turn and after the question two turns before; each answer is the result of the turn before.

    Without a turn number, it is a call or result without id.
    """
    if role == "assistant":
        yield "result", None if turn is None else str(turn - 1), None, None, [], canonical(text), False
    else:
        arguments = json.dumps({"role": role, "text": text, "turn": turn})
        yield "call", None if turn is None else str(turn), "answer" if role == "user" else "instruct", arguments, [str(turn - 2)] if turn is not None and turn > 1 else [], None, False


#: Schemas of the calls that turn_parts makes.
TURN_SCHEMAS = {
    name: {
        "type": "object",
        "required": ["role", "text", "turn"],
        "additionalProperties": False,
        "properties": {"role": {"type": "string", "enum": roles}, "text": {"type": "string", "minLength": 1, "pattern": "\\S"}, "turn": {"type": "integer", "minimum": 0}},
    }
    for name, roles in (("answer", ["user"]), ("instruct", ["system"]))
}


def parse(conversations: DataFrame, read: Callable = marked_parts) -> DataFrame:
    """The calls and results of every turn of `conversations` (conv_id, turn, role, text), numbered by place within the turn: see PARTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(kind, conv, turn, place, *rest) for place, (kind, *rest) in enumerate(read(turn, role, text or ""))]
            columns = zip(*rows, strict=True) if rows else ([],) * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    return conversations.select(*long, "role", "text").mapInArrow(run, PARTS)


def levelled(edges: list[tuple[str, str]]) -> dict[str, int | None]:
    """The level of every node that has a predecessor, none if it is on a cycle or after one, from distinct edges (node, before)."""
    after, missing, level = defaultdict(list), defaultdict(int), {}
    for node, before in edges:
        after[before].append(node)
        missing[node] += 1
    ready = [x for x in after if x not in missing]
    for x in ready:
        for node in after[x]:
            level[node] = max(level.get(node, 0), level.get(x, 0) + 1)
            missing[node] -= 1
            if not missing[node]:
                ready.append(node)
    return {node: None if n else level[node] for node, n in missing.items()}


def _levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels within each conversation, from rows (c, node, before) that are sorted by it. One conversation's links are held at a time."""
    names = ["c", "i", "level"]
    types = [pa.int64(), pa.string(), pa.int64()]
    now, held, out = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        out.clear()

    for batch in batches:
        for c, node, before in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != now:
                out += [(now, node_, level) for node_, level in levelled(held).items()]
                now, held = c, []
                if len(out) > 10_000:
                    yield from flush()
            held.append((node, before))
    out += [(now, node_, level) for node_, level in levelled(held).items()]
    if out:
        yield from flush()


def _levels(edges: DataFrame, nodes: DataFrame, held: int = HELD) -> DataFrame:
    """(node, level) of the nodes with predecessors; no level for those that a cycle precedes. `edges` has node and before, distinct, both among the nodes."""
    large = settle(edges.groupBy(F.col("node.c").alias("large")).agg(F.count("*").alias("n")).where(F.col("n") > held).select("large"))
    own = F.col("node.c") == F.col("large")
    several = not large.isEmpty()
    small = edges.join(large, own, "left_anti") if several else edges
    flat = small.select(F.col("node.c").alias("c"), F.col("node.i").alias("node"), F.col("before.i").alias("before"))
    sorted_ = flat.repartition("c").sortWithinPartitions("c")
    done = sorted_.mapInArrow(_levelled, "c long, i string, level long").select(F.struct("c", "i").alias("node"), "level")
    if several:
        rest = edges.join(large, own, "left_semi")
        found = _large_levels(rest, nodes.join(large, own, "left_semi"))
        done = done.unionByName(rest.select("node").distinct().join(found, "node", "left"))
    return done


def _large_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for conversations of any size."""
    degree = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("before").alias("to"))
    # Pointers end at a node with no predecessor or with several.
    state = nodes.join(degree, "node", "left").select("node", F.when(F.col("n") == 1, F.col("to")).otherwise(F.col("node")).alias("to"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("far"), (F.coalesce("n", F.lit(0)) != 1).alias("end"))
    state = settle(state)
    rounds = max(1, state.count()).bit_length()
    for _ in range(rounds):
        next_ = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("end").alias("end2"))
        # A node that points to an end is done; the others leap as far again.
        leap = state.where("not end").join(next_, "to").select("node", F.when(F.col("end2"), F.col("to")).otherwise(F.col("to2")).alias("to"), F.when(F.col("end2"), F.col("far")).otherwise(F.col("far") + F.col("far2")).alias("far"), F.lit(False).alias("end"), "end2")
        moved = settle(leap)
        state = state.where("end").unionByName(moved.drop("end2"))
        if moved.where("not end2").isEmpty():
            break
    several = settle(degree.where("n > 1").select("node"))
    roots = nodes.join(degree, "node", "left_anti").select("node", F.lit(0).cast("long").alias("level"))
    ends = roots
    if not several.isEmpty():
        steps = edges.join(several, "node").join(state.select(F.col("node").alias("before"), F.col("to").alias("end_node"), "far"), "before").select("node", "end_node", (F.col("far") + 1).alias("far"))
        steps = settle(steps)
        ends = settle(roots)
        while True:
            known = steps.join(ends.select(F.col("node").alias("end_node"), "level"), "end_node", "left")
            done = known.groupBy("node").agg(F.max(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("far")).alias("level")).where("not open").select("node", "level")
            done = settle(done.join(ends, "node", "left_anti"))
            if done.isEmpty():
                break
            ends = settle(ends.unionByName(done))
    return state.select("node", F.col("to").alias("end_node"), "far").join(ends.select(F.col("node").alias("end_node"), "level"), "end_node").select("node", (F.col("level") + F.col("far")).alias("level"))


LINKED = "conv_id long, turn long, place int, id string, name string, level long, duplicate boolean, unknown_after int, n_results long, result_turn long, early boolean, valid boolean, errors string, json string"


def link(parts: DataFrame, schemas: dict[str, dict], held: int = HELD) -> DataFrame:
    """One row per call, and per result that no call asks for, from the rows of `parse`: see LINKED.

    Of calls with one id in a conversation the first by (turn, place) has the results and is what others come after; the later ones, and all but one of
    repeated rows, are `duplicate` and have no results. Calls and results without id link with nothing. A call with several results has the first one's turn and
    content. `early`: that result's turn is before the call's. `unknown_after` counts named predecessors that are no calls of the conversation. `valid` is null
    for tools without a schema, and false for broken arguments; `errors` lists what is wrong: paths with the schema's keywords, $:json for arguments that are no
    JSON, and result:json for such a content. `json` is the canonical object of the call with its result. Null conversations are one
    conversation. Rows for orphan results have a null name and level. An empty table gives an empty one.
    Conversations of over `held` links between calls are levelled in rounds.
    """
    # The number tells repeated rows apart; it is made once, as the rows are settled with it.
    parts = settle(parts.withColumn("number", F.monotonically_increasing_id()))
    calls = parts.where("kind = 'call'").withColumn("row", F.struct("turn", "place", "number"))
    named = calls.where("id is not null")
    first = named.groupBy("conv_id", "id").agg(F.min("row").alias("first_row"), F.min_by(F.struct(F.array_distinct(F.coalesce("after", F.array().cast("array<string>"))).alias("after")), "row").alias("f"))
    first = settle(first.withColumn("node", F.struct(F.coalesce("conv_id", F.lit(-(1 << 63))).alias("c"), F.col("id").alias("i"))))
    wanted = first.select("node", F.explode("f.after").alias("to")).select("node", F.struct(F.col("node.c").alias("c"), F.col("to").alias("i")).alias("before"))
    exists = first.select(F.col("node").alias("before"), F.lit(True).alias("there"))
    checked = settle(wanted.join(exists, "before", "left"))
    edges = checked.where("there").select("node", "before")
    levels = _levels(edges, first.select("node"), held).withColumn("preceded", F.lit(True))
    unknown = checked.where("there is null").groupBy("node").agg(F.count("*").cast("int").alias("unknown_after"))
    results = parts.where("kind = 'result'")
    answered = results.where("id is not null").groupBy("conv_id", "id").agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "place", "content", "broken")).alias("r"))
    level = F.when(F.col("preceded"), F.col("level")).otherwise(0).alias("level")
    known = first.join(levels, "node", "left").join(unknown, "node", "left").select("conv_id", "id", "first_row", level, "unknown_after")
    renamed = answered.select(F.col("conv_id").alias("rc"), F.col("id").alias("ri"), "n_results", "r")
    both = known.join(renamed, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("id") == F.col("ri")), "full_outer")
    orphans = both.where("id is null").select(F.col("rc").alias("conv_id"), F.col("ri").alias("id"), "n_results", "r")
    told = both.where("id is not null").select(F.col("conv_id").alias("kc"), F.col("id").alias("ki"), "first_row", "level", "unknown_after", "n_results", "r")
    met = calls.join(told, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("id") == F.col("ki")), "left")
    own = F.coalesce(F.col("row") == F.col("first_row"), F.lit(True))
    columns = ["conv_id", "turn", "place", "id", "name", "level", "duplicate", "unknown_after", "n_results", "result_turn", "arguments", "after", "content", "broken"]
    rows = met.select(
        "conv_id", "turn", "place", "id", "name", F.when(own, F.coalesce("level", F.when(F.col("id").isNull(), 0).cast("long"))).alias("level"), (~own).alias("duplicate"), F.when(own, F.coalesce("unknown_after", F.lit(0))).otherwise(0).alias("unknown_after"),
        F.when(own, F.coalesce("n_results", F.lit(0))).otherwise(0).cast("long").alias("n_results"), F.when(own, F.col("r.turn")).alias("result_turn"), "arguments", "after", F.when(own, F.col("r.content")).alias("content"), F.when(own, F.col("r.broken")).alias("broken"),
    )
    loose = results.where("id is null").select("conv_id", "id", F.lit(1).cast("long").alias("n_results"), F.struct("turn", "place", "content", "broken").alias("r"))
    void = lambda t: F.lit(None).cast(t)
    lost = orphans.unionByName(loose).select("conv_id", void("long").alias("turn"), void("int").alias("place"), "id", void("string").alias("name"), void("long").alias("level"), F.lit(False).alias("duplicate"), F.lit(0).alias("unknown_after"), "n_results", F.col("r.turn").alias("result_turn"), void("string").alias("arguments"), void("array<string>").alias("after"), F.col("r.content").alias("content"), F.col("r.broken").alias("broken"))
    return rows.select(*columns).unionByName(lost.select(*columns)).mapInArrow(lambda it: _serialise(it, schemas), LINKED)


def _serialise(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        valid, errors, texts, early = [], [], [], []
        for i in range(batch.num_rows):
            name, raw, own, content = (columns[c][i] for c in ("name", "arguments", "id", "content"))
            turn, back = columns["turn"][i], columns["result_turn"][i]
            early.append(turn is not None and back is not None and back < turn)
            is_call = raw is not None
            found: list[str] = []
            arguments = None
            try:
                arguments = json.loads(raw) if is_call else None
                canonical({"arguments": arguments})
                if is_call and name in schemas:
                    found = violations(arguments, schemas[name])
            except WRONG:
                arguments, found = None, ["$:json"]
            valid.append((not found if name in schemas or found else None) if is_call else None)
            errors.append(";".join([*found, *["result:json"] * bool(columns["broken"][i])]))
            whole = {"id": own, "name": name, "arguments": arguments, "after": columns["after"][i] or []} if is_call else {"id": own}
            text = canonical(whole)
            texts.append(text if content is None else text[:-1] + ',"result":' + content + "}")
        out = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "turn", "place", "id", "name", "level", "duplicate", "unknown_after", "n_results", "result_turn")]
        out += [pa.array(early, pa.bool_()), pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in LINKED.split(", ")])
