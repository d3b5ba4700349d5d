import json
from collections import defaultdict
from datetime import datetime
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from parleyspark.operators.nested import NestedTables, _decode_deep, decode, identities, leaves, shred_one, spelling

SCHEMA = "record_id bigint, exported_at timestamp, payload string, blocks string, nodes int"
values = st.recursive(st.none() | st.booleans() | st.integers(-(2**60), 2**60) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(values)
def test_decoders_agree(value):
    text = json.dumps(value, ensure_ascii=False, indent=1)
    assert decode(text) == _decode_deep(text) == json.loads(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=5), values, max_size=4))
def test_objects_and_links_give_the_payload_back(members):
    payload = {"uuid": "u", **{k: v for k, v in members.items() if k != "uuid"}}
    nodes = shred_one(json.dumps(payload), True)["nodes"]
    kids = defaultdict(list)
    for n in nodes:
        kids[n["parent"]].append(n)

    def build(n):
        below = sorted(kids[n["node"]], key=lambda x: x["ordinal"])
        if n["kind"] == "object":
            return {x["member"]: build(x) for x in below}
        if n["kind"] == "array":
            return [build(x) for x in below]
        return {"null": lambda v: None, "string": str, "boolean": lambda v: v == "true", "number": Decimal}[n["kind"]](n["value"])

    # numbers are compared as the decimals that the text holds
    assert build(nodes[0]) == json.loads(json.dumps(payload), parse_float=Decimal, parse_int=Decimal)


def test_identity_ignores_order_of_members_and_spelling_of_numbers():
    a, b = decode('{"a": [1, {"x": 1.0, "y": null}], "b": "1"}'), decode('{"b":"1","a":[1,{"y":null,"x":1}]}')
    assert identities(a)[0][id(a)] == identities(b)[0][id(b)]
    c = decode('{"a": [{"x": 1, "y": null}, 1], "b": "1"}')
    assert identities(a)[0][id(a)] != identities(c)[0][id(c)]


def test_numbers_of_any_length_keep_their_value():
    def identity(text):
        x = decode(f"[{text}]")
        return identities(x)[0][id(x)]

    long = "7" * 400
    assert identity(long + "1") != identity(long + "2") and identity("9" * 5000 + "1") != identity("9" * 5000 + "2")
    assert identity("1e400") != identity("1e401") and identity("-1e400") != identity("1e400") and identity("1E400") == identity("10.0e399") == identity("1" + "0" * 400)
    assert identity("1e20") == identity("100000000000000000000") == identity("100000000000000000000.0") and identity("0.1") == identity("1e-1") == identity("0.1000")
    assert identity("0.1") != identity("0.1000000000000000000001") and identity("-0.0") == identity("0") and identity("9007199254740993") != identity("9007199254740993.5")
    node = lambda t: shred_one('{"uuid": "u", "n": ' + t + "}", True)["nodes"][-1]["value"]
    assert node(long) == spelling(long) == long[0] + "." + long[1:] + "e+399" and node("12.50") == "12.5" and node("1e5") == "100000" and node("0.00012") == "0.00012"


def test_bad_payloads():
    for bad in (None, "", "  ", "{", "[]", "null", '"x"', '{"uuid": null}', '{"uuid": ""}', '{"uuid": 5}', '{"uuid": "a", "x": NaN}', '{"uuid": "a"} x'):
        assert shred_one(bad, False) is None
    assert _fails('{"a" 1}') and _fails("[1,]") and _fails('{"a":1,}') and _fails("[1 2]") and _fails("")


def _fails(text):
    try:
        _decode_deep(text)
    except (ValueError, IndexError):
        return True
    return False


def test_very_deep():
    n = 30_000
    deep = '{"uuid": "a", "chat_messages": [{"uuid": "m", "content": ' + '[{"type": "t", "content": ' * n + "[]" + "}]" * n + "}]}"
    assert len(shred_one(deep, False)["blocks"]) == n
    assert leaves([[{"a": 1, "b": None}], "x"]) in ([("$[0][0].a", "1"), ("$[1]", "x")], [("$[1]", "x"), ("$[0][0].a", "1")])


def test_tables(spark):
    def conv(name, text):
        return json.dumps({"uuid": name, "chat_messages": [None, {"uuid": "m1", "content": text}, {"uuid": "m2", "content": [None, {"type": "tool_use", "id": "t", "input": {"a": [1, None], "b": "x"}}, "s", {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "input": 5}]}]}]})

    day = lambda d: datetime(2025, 1, d)
    rows = [(1, day(1), conv("c", "old"), "z", 0), (2, day(2), conv("c", "new"), None, 0), (3, day(2), conv("d", ["\ud800"]), None, 0), (4, None, conv("c", "none"), None, 0), (5, day(9), "{", None, 0), (2, day(2), conv("c", "new"), None, 0), (None, day(3), conv("e", 5), None, 0)]
    t = NestedTables(spark.createDataFrame(rows, SCHEMA), all_nodes=True)
    blocks = {(r["conversation_uuid"], r["message_uuid"], r["block_path"], r["block_type"], r["tool_ref"]) for r in t.blocks().collect()}
    inner = {("m2", "1", "tool_use", "t"), ("m2", "3", "tool_result", "t"), ("m2", "3.0", "text", "")}
    assert blocks == {(c, *x) for c in "cde" for x in inner} | {("c", "m1", "0", "text", "")}
    assert {(r["path"], r["value"]) for r in t.input_values().collect()} == {("$.a[0]", "1"), ("$.b", "x"), ("$", "5")}
    assert t.inputs().count() == 2
    assert {(r["conversation_uuid"], r["result_path"]) for r in t.tool_links().collect()} == {(c, "3") for c in "cde"}
    assert t.objects().where("kind = 'string' and value = 'tool_use'").first()["n_occurrences"] == t.conversations().count()


def test_empty(spark):
    t = NestedTables(spark.createDataFrame([], SCHEMA))
    assert t.blocks().count() == t.inputs().count() == t.tool_links().count() == 0
