import json
import random

import pytest

from evenhand.llm import toolcalls

SCHEMA = "conv_id bigint, turn bigint, seq int, kind string, call_id string, name string, arguments string, content string, after string, place string"


def call(conv, turn, call_id, after=None, name="lookup", arguments='{"key": "k"}'):
    return (conv, turn, 0, "call", call_id, name, arguments, None, after, "clash")


def result(conv, turn, call_id, content="done"):
    return (conv, turn, 1, "result", call_id, None, None, content, None, "clash")


def run(spark, rows):
    return toolcalls.link(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect()


def test_order_puts_parents_first_and_keeps_what_is_in_order(spark):
    rows = [result(1, 0, "a"), call(1, 1, "a"), call(1, 2, "b", after="c"), result(1, 3, "b"), call(1, 4, "c"), result(1, 5, "c"), call(1, 6, "d")]
    got = [(r.kind, r.call_id, r.status) for r in run(spark, rows)]
    assert got == [("call", "a", "linked"), ("result", "a", "linked"), ("call", "c", "linked"), ("result", "c", "linked"), ("call", "b", "linked"), ("result", "b", "linked"), ("call", "d", "unanswered")]


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_are_ordered(spark, seed):
    rng = random.Random(seed)
    rows, parents = [], {}
    for conv in range(4):
        ids = [f"{conv}-{i}" for i in range(25)]
        rank = {x: i for i, x in enumerate(rng.sample(ids, len(ids)))}
        for x in ids:
            earlier = [y for y in ids if rank[y] < rank[x]]
            after = rng.choice(earlier) if earlier and rng.random() < 0.6 else None
            parents[conv, x] = after
            rows += [call(conv, rng.randrange(50), x, after), result(conv, rng.randrange(50), x)]
    rng.shuffle(rows)
    out = run(spark, rows)
    place = {(r.conv_id, r.kind, r.call_id): r.position for r in out}
    for conv in range(4):
        assert sorted(p for (c, *_), p in place.items() if c == conv) == list(range(50))
    for (conv, x), after in parents.items():
        assert place[conv, "call", x] < place[conv, "result", x]
        if after:
            assert place[conv, "result", after] < place[conv, "call", x]
    assert {r.status for r in out} == {"linked"}


def test_long_chain_and_cycles(spark):
    chain = [call(1, 100 - i, f"c{i}", f"c{i - 1}" if i else None) for i in range(100)]
    ring = [call(2, i, f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [call(2, 9, "behind", "r0"), call(2, 10, "free")]
    out = run(spark, chain + ring)
    assert [r.call_id for r in out if r.conv_id == 1] == [f"c{i}" for i in range(100)]
    assert {r.call_id for r in out if r.status == "cyclic"} == {f"r{i}" for i in range(5)} | {"behind"}
    assert [r.call_id for r in out if r.conv_id == 2][0] == "free"


def test_statuses_nulls_and_repeated_rows(spark):
    rows = [call(1, 0, "a"), call(1, 0, "a"), result(1, 1, "a"), result(1, 1, "a"), result(1, 2, "x"), call(1, 3, None), call(1, 4, "", arguments=None), call(None, None, "n"), result(None, None, "n"), call(1, 5, "z", after="gone")]
    out = run(spark, rows)
    count = lambda **k: sum(all(getattr(r, f) == v for f, v in k.items()) for r in out)
    assert len(out) == len(rows)
    assert count(status="linked", conv_id=1) == 2 and count(status="duplicate") == 2 and count(status="orphan") == 1 and count(status="no_id") == 2
    assert count(status="linked", conv_id=None) == 2
    assert [r.errors for r in out if r.call_id == "z"] == [["after: no call gone"]]
    assert run(spark, []) == []


def test_arguments_and_canonical_json(spark):
    cases = [
        ("search", '{"query": "é \\u00e9", "limit": 5.0}', []), ("search", '{"limit": 0, "query": ""}', ["$.limit: out of range", "$.query: too short"]),
        ("search", '{"x": 1}', ["$.query: missing", "$.x: unknown"]), ("search", '{"query": "q", "limit": true}', ["$.limit: not integer"]),
        ("search", "[1]", ["$: not object"]), ("search", "{", ["$: no JSON"]), ("search", None, ["$: no arguments"]), ("nothing", "{}", ["unknown tool nothing"]),
        ("summarise", '{"text": "t", "style": "odd", "tags": ["a", 1]}', ["$.style: not allowed", "$.tags[1]: not string"]),
    ]
    out = run(spark, [call(1, i, f"i{i}", name=n, arguments=a) for i, (n, a, _) in enumerate(cases)])
    assert [r.errors for r in out] == [e for _, _, e in cases]
    assert out[0].json == '{"arguments":{"limit":5,"query":"é é"},"id":"i0","name":"search","type":"tool_call"}'
    assert json.loads(out[5].json)["arguments"] == "{"
    assert toolcalls.canonical({"b": [1.0, 1.5, None, True], "a": {"z": "\n"}}) == '{"a":{"z":"\\n"},"b":[1,1.5,null,true]}'


def test_derived_events_are_linked(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    events = toolcalls.derived_events(turns)
    out = toolcalls.link(events)
    assert out.count() == events.count()
    assert {"linked", "unanswered", "orphan"} <= {r.status for r in out.select("status").distinct().collect()}
    broken = out.where("kind = 'call' and not valid").count()
    assert 0 < broken < out.where("kind = 'call'").count() / 2


def test_derived_arguments_hold_the_whole_text(spark):
    """Every complete call has its turn's text, whatever its length."""
    texts = {turn: f"turn {turn} " + "long \u00e9\n\"quoted\" text " * (1 + 40 * (turn % 3 == 0)) + "end" for turn in range(0, 240)}
    turns = spark.createDataFrame([(1, turn, "assistant", text) for turn, text in texts.items()] + [(1, 240, "system", "rules")], "conv_id bigint, turn int, role string, text string")
    rows = toolcalls.derived_events(turns).collect()
    assert sorted(r.turn for r in rows) == sorted(texts)
    field, seen = {"search": "query", "lookup": "key", "summarise": "text"}, 0
    for r in rows:
        value, wrong = toolcalls.parse(r.arguments)
        if wrong:
            assert json.dumps(texts[r.turn], ensure_ascii=False)[1:-1] in r.arguments
        elif field[r.name] in value:
            assert value[field[r.name]] == texts[r.turn]
            seen += 1
    assert seen > 150


def test_legal_json_that_cannot_be_kept(spark):
    """Each is an error on its own row; the text stays, and canonical JSON can be read back."""
    texts = {
        '{"key": "k", "exact": true, "n": ' + "9" * 400 + "}": "$.n: unknown", '{"limit": ' + "9" * 400 + ', "query": "q"}': "$.exact", '{"key": "\\ud800"}': "$: no text", "[" * 3000 + "]" * 3000: "$: too deep",
        "[" * 100_000 + "]" * 100_000: "$: ", '{"key": NaN}': "$: no JSON", '{"key": -Infinity}': "$: no JSON", '{"key": 1e999}': "$: no JSON", '{"key": ' + "1" * 5000 + "}": "$: no JSON", "": "$: no JSON", '{"key": "\\ud83d\\ude00"}': "",
    }
    rows = [call(1, k, f"c{k}", arguments=t) for k, t in enumerate(texts)]
    got = run(spark, rows)
    assert len(got) == len(texts)
    for r, (text, error) in zip(got, texts.items()):
        event = json.loads(r.canonical if hasattr(r, "canonical") else r.json)
        if error.startswith("$: "):
            assert event["arguments"] == text and r.errors[0].startswith(error), text[:40]
        elif not error:
            assert event["arguments"] == {"key": "\U0001f600"} and r.errors == []
    assert toolcalls.errors_of(10**400, {"type": "integer", "maximum": 50}) == ["$: out of range"] and toolcalls.errors_of(1.5, {"type": "integer"}) == ["$: not integer"]
