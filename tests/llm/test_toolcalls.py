"""Linking, levels, schemas and canonical JSON against plain Python over whole conversations."""

import json
import random
import time

import pytest

from changelake.llm import toolcalls

SCHEMA = "conv_id long, turn long, role string, text string, id string, level string"


def brute_levels(after):
    """Longest chain lengths by id, without those on or after a cycle."""
    out = {}
    for _ in range(len(after) + 1):
        for i, before in after.items():
            known = [b for b in before if b in after]
            if i not in out and all(b in out for b in known):
                out[i] = 1 + max((out[b] for b in known), default=-1)
    return out


def call(i, after=(), **arguments):
    return f"<tool_call>{json.dumps({'id': i, 'name': 'add', 'arguments': arguments, 'after': list(after)})}</tool_call>"


def test_canonical():
    assert toolcalls.canonical({"b": 1.0, "a": [True, None, 1.5, "é\n"], "\U0001f600": 1, "דּ": 2}) == '{"a":[true,null,1.5,"é\\n"],"b":1,"\U0001f600":1,"דּ":2}'
    value = {"z": {"y": [1, {"x": "q"}]}, "a": 1e30, "m": -0.0}
    assert json.loads(toolcalls.canonical(value)) == value and toolcalls.canonical(json.loads(toolcalls.canonical(value))) == toolcalls.canonical(value)


def test_schemas():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0, "maximum": 9}, "s": {"type": ["string", "null"], "minLength": 2, "maxLength": 3, "pattern": "^x"}, "l": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"enum": [1, "b"]}}}}
    check = lambda v: toolcalls.violations(v, schema)
    assert check({"a": 1, "s": "xy", "l": [1.0, "b"]}) == check({"a": 2.0, "s": None}) == []
    assert check([]) == ["$:type"] and check({}) == ["$.a:required"] and check({"a": True}) == check({"a": 1.5}) == check({"a": "1"}) == ["$.a:type"]
    assert check({"a": -1}) == ["$.a:minimum"] and check({"a": 10}) == ["$.a:maximum"] and check({"a": 1, "q": 1}) == ["$.q:additionalProperties"]
    assert check({"a": 1, "s": "abcd"}) == ["$.s:maxLength", "$.s:pattern"] and check({"a": 1, "l": []}) == ["$.l:minItems"] and check({"a": 1, "l": [2, 1, 1]}) == ["$.l:maxItems", "$.l[0]:enum"]


@pytest.mark.parametrize("held", [toolcalls.HELD, 38, 0])
def test_levels_of_chains_dags_and_cycles(spark, held):
    rng, rows, want = random.Random(3), [], {}
    for conv in range(6):
        ids = [f"c{i}" for i in range(40)]
        after = {}
        for n, i in enumerate(ids):
            after[i] = [ids[n - 1]] if conv == 0 and n else sorted(set(rng.choices(ids[:n], k=rng.randint(0, 3)))) if n and conv else []
        if conv in (4, 5):
            after[ids[5]] = [ids[9]]
            after[ids[9]] = [ids[5]] if conv == 4 else [ids[5], ids[0]]
        if conv == 3:
            order = ids[:]
            rng.shuffle(order)  # predecessors may come later in the text
        else:
            order = ids
        rows += [(conv, n, "assistant", call(i, after[i], a=1), "", "") for n, i in enumerate(order)]
        want |= {(conv, i): v for i, v in brute_levels(after).items()}
    got = toolcalls.link(toolcalls.parse(spark.createDataFrame(rows, SCHEMA)), {}, held).collect()
    assert len(got) == 240 and {(r.conv_id, r.id): r.level for r in got if r.level is not None} == want
    assert want[0, "c39"] == 39 and any(r.level is None for r in got)


def test_linking(spark):
    ok = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}
    result = lambda i, c: f"<tool_result>{json.dumps({'id': i, 'content': c})}</tool_result>"
    rows = [
        (1, 1, "assistant", call("x", a=1) + " and " + call("y", ["x", "gone"], a="no"), "", ""),
        (1, 2, "tool", result("y", {"b": 1, "a": 2}) + result("y", 3), "", ""),
        (1, 3, "assistant", call("x", a=5), "", ""),
        (1, 4, "tool", result("nobody", 1), "", ""),
        (2, 0, "tool", result("x", "early"), "", ""),
        (2, 1, "assistant", call("x", a=2), "", ""),
        (2, 2, "assistant", "<tool_call>{broken</tool_call> <tool_result>[1]</tool_result>", "", ""),
        (3, None, None, None, "", ""),
        (None, 1, "assistant", call("x", a=1) + result("x", None), "", ""),
        (3, 5, "user", "no calls here", "", ""),
    ]
    got = toolcalls.link(toolcalls.parse(spark.createDataFrame(rows, SCHEMA)), {"add": ok}).collect()
    by = {(r.conv_id, r.turn, r.place): r for r in got}
    x, y, again = by[1, 1, 0], by[1, 1, 1], by[1, 3, 0]
    assert (x.level, x.n_results, x.valid, x.duplicate, x.result_turn) == (0, 0, True, False, None)
    assert (y.level, y.n_results, y.valid, y.unknown_after, y.result_turn, y.errors) == (1, 2, False, 1, 2, "$.a:type")
    assert y.json == '{"after":["x","gone"],"arguments":{"a":"no"},"id":"y","name":"add","result":{"a":2,"b":1}}'
    assert again.duplicate and again.level is None and again.n_results == 0
    assert by[2, 1, 0].early and by[2, 1, 0].json.endswith('"result":"early"}') and not y.early
    assert by[2, 2, 0].valid is False and by[2, 2, 0].errors == "$:json"
    assert by[None, 1, 0].n_results == 1 and by[None, 1, 0].json.endswith('"result":null}')
    lost = sorted((r.conv_id, r.id or "", r.json) for r in got if r.turn is None)
    assert lost == [(1, "nobody", '{"id":"nobody","result":1}'), (2, "", '{"id":null}')]
    assert len(got) == 6 + 2  # calls and lost results


def test_marks():
    text = "a <tool_result>1</tool_result><tool_call>2 <tool_result>3</tool_call> <tool_call>4 <tool_result>5</tool_result>"
    assert list(toolcalls.marked(text)) == [("result", "1"), ("call", "2 <tool_result>3"), ("result", "5")]
    start = time.perf_counter()
    assert list(toolcalls.marked("<tool_call>" * 200_000 + "<tool_result>x</tool_result>" * 1000)) == [("result", "x")] * 1000
    assert list(toolcalls.marked("<tool_result></tool_call>" * 100_000)) == []
    assert time.perf_counter() - start < 10


def test_broken_messages(spark):
    """No message ends the job: what is no JSON is reported, and what can be linked is."""
    deep = "[" * 50_000 + "]" * 50_000
    said = lambda kind, body: f"<tool_{kind}>{body}</tool_{kind}>"
    rows = [
        (1, 0, "assistant", call("a", x=1) + said("result", '{"id":"a","content":NaN}'), "", ""),
        (1, 1, "assistant", said("call", '{"id":"\\ud800","name":"add","arguments":{"a":1},"after":["\\udfff","a"]}'), "", ""),
        (1, 2, "assistant", said("call", '{"id":"b","name":"add","arguments":{"a":"\\ud800"}}') + said("result", '{"id":"b","content":"\\udc00"}'), "", ""),
        (1, 3, "assistant", said("call", f'{{"id":"c","name":"add","arguments":{deep}}}') + said("result", f'{{"id":"d","content":{deep}}}'), "", ""),
        (1, 4, "assistant", said("call", '{"id":"e","name":"\\ud800","arguments":{"a":Infinity}}') + said("call", "9" * 5000) + said("call", '{"id":"f","arguments":1e999}'), "", ""),
        (1, 5, "assistant", "word " * 300_000 + call("g", a=1), "", ""),
        (1, 6, "assistant", said("result", '{"id":"g","content":' + "9" * 5000 + "}"), "", ""),
    ]
    got = toolcalls.link(toolcalls.parse(spark.createDataFrame(rows, SCHEMA)), {"add": {"type": "object"}}).collect()
    by = {(r.turn, r.place): r for r in got if r.turn is not None}
    assert by[0, 0].errors == "result:json" and by[0, 0].valid and by[0, 0].n_results == 1 and "result" not in json.loads(by[0, 0].json)
    assert by[1, 0].id is None and json.loads(by[1, 0].json)["after"] == ["a"] and by[1, 0].valid
    assert by[2, 0].errors == "$:json;result:json" and by[2, 0].valid is False
    assert by[3, 0].errors == "$:json" and by[3, 0].id is None
    assert by[4, 0].errors == "$:json" and by[4, 0].name is None and by[4, 0].id == "e" and by[4, 1].errors == "$:json" and by[4, 2].errors == "$:json"
    assert by[5, 0].valid and by[5, 0].n_results == 0
    assert all(json.loads(r.json) is not None for r in got) and sorted(r.errors for r in got if r.turn is None) == ["result:json", "result:json"]


def test_repeated_rows_and_turns_without_numbers(spark):
    row = (1, 1, "assistant", call("x", a=1) + "<tool_result>{\"id\":\"x\",\"content\":1}</tool_result>", "", "")
    got = toolcalls.link(toolcalls.parse(spark.createDataFrame([row, row, row], SCHEMA)), {}).collect()
    assert sorted((r.duplicate, r.n_results) for r in got) == [(False, 3), (True, 0), (True, 0)]
    rows = [(1, None, "user", "a", "", ""), (1, None, "assistant", "b", "", ""), (1, -1, "user", "c", "", ""), (1, -2, "user", "d", "", "")]
    got = toolcalls.link(toolcalls.parse(spark.createDataFrame(rows, SCHEMA), toolcalls.turn_parts), toolcalls.TURN_SCHEMAS).collect()
    assert {(r.turn, r.id, r.n_results) for r in got} == {(None, None, 0), (None, None, 1), (-1, "-1", 0), (-2, "-2", 0)}


def test_turns(spark):
    rows = [(1, 0, "system", "be kind", "", "")] + [(1, t, "user" if t % 2 else "assistant", f"t{t}" if t != 7 else " ", "", "") for t in range(1, 60)]
    parts = toolcalls.parse(spark.createDataFrame(rows, SCHEMA), toolcalls.turn_parts)
    got = {r.turn: r for r in toolcalls.link(parts, toolcalls.TURN_SCHEMAS).collect()}
    assert sorted(got) == [0, *range(1, 60, 2)]
    assert all(got[t].level == t // 2 and got[t].result_turn == (t + 1 if t < 59 else None) and got[t].valid == (t != 7) for t in range(1, 60, 2))
    assert json.loads(got[3].json) == {"after": ["1"], "arguments": {"role": "user", "text": "t3", "turn": 3}, "id": "3", "name": "answer", "result": "t4"}


def test_empty(spark):
    assert toolcalls.link(toolcalls.parse(spark.createDataFrame([], SCHEMA)), {}).count() == 0
