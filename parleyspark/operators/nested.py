"""Deeply nested JSON records to flat tables, with Merkle identities of all subtrees.

Every object, list and scalar gets an identity hashed bottom-up over its canonical form (members by key, numbers of any
length in one decimal spelling), so that equal subtrees have equal identities wherever they stand. Identical ones are stored once; every
occurrence is kept as a bridge row with its parent and its ordinal.

Defined cases: NULL, blank or invalid JSON (NaN and Infinity included), a value that isn't an object and an object whose
``uuid`` isn't a non-empty string give no rows; list elements that are null count as positions only; members of the wrong
kind count as absent; nesting of any depth is read; unpaired surrogates become U+FFFD; of a repeated key the last counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleyspark.plans.stage import Stage

#: Anti-join sides are broadcast up to this number of rows of one BIGINT.
BROADCAST_ROWS = 200_000
#: Characters of payload whose rows leave a worker together.
_FLUSH_CHARS = 4_000_000

_NODE = "array<struct<node:int,parent:int,member:string,ordinal:int,object_id:binary,kind:string,value:string>>"
_MESSAGE = "array<struct<message_uuid:string,ordinal:int,sender:string,object_id:binary>>"
_BLOCK = "array<struct<message_uuid:string,block_path:string,parent_path:string,ordinal:int,block_type:string,tool_ref:string,object_id:binary,input_id:binary>>"
_INPUT = "array<struct<input_id:binary,leaves:array<struct<path:string,value:string>>>>"
SHREDDED = f"record_id bigint, exported_at timestamp, conversation_uuid string, root_id binary, messages {_MESSAGE}, blocks {_BLOCK}, inputs {_INPUT}, nodes {_NODE}"


def _constant(name: str) -> None:
    raise ValueError(name)


_DECIMAL = re.compile(r"(-?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?")
#: Longer integers stay text: the interpreter doesn't convert them.
_INTEGER_DIGITS = 4_000


class Exact(float):
    """A number that no float equals; ``text`` is its one spelling."""

    text: str


def spelling(text: str) -> str:
    """The one spelling of a decimal number, whatever its length: equal numbers get equal texts, different ones don't."""
    sign, whole, part, power = _DECIMAL.fullmatch(text).groups()
    digits = (whole + part).lstrip("0")
    if not digits:
        return "0"
    kept = digits.rstrip("0")
    # the value is kept * 10 ** e
    e = int(power or 0) - len(part) + len(digits) - len(kept)
    if 0 <= e and len(kept) + e <= 21:
        return sign + kept + "0" * e
    if e < 0 and len(kept) + e > 0:
        return f"{sign}{kept[:e]}.{kept[e:]}"
    if e < 0 and len(kept) + e > -6:
        return f"{sign}0.{'0' * -(len(kept) + e)}{kept}"
    more = f".{kept[1:]}" if len(kept) > 1 else ""
    return f"{sign}{kept[0]}{more}e{e + len(kept) - 1:+d}"


def _number(text: str) -> int | float:
    x = float(text)
    if x.is_integer() and abs(x) < 2**53 and len(text) < 18:
        return int(x)
    one = spelling(text)
    if x in (float("inf"), float("-inf")) or spelling(repr(x)) != one:
        x = Exact(x)
        x.text = one
    return x


def _integer(text: str) -> int | float:
    return int(text) if len(text) < _INTEGER_DIGITS else _number(text)


_DECODER = json.JSONDecoder(parse_constant=_constant, parse_float=_number, parse_int=_integer)
_PIECE = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def _decode_deep(text: str):
    """json.loads without recursion, for nesting beyond the interpreter's limit."""
    at, stack, root, key = 0, [], [], None
    want = "value"  # value, value-or-], key, key-or-}, colon, comma
    while True:
        m = _PIECE.match(text, at)
        if not m:
            if stack or want != "end" or text[at:].strip(" \t\n\r"):
                raise ValueError(at)
            return root[0]
        at = m.end()
        if want == "end":
            raise ValueError(at)
        sign = m[1]
        if want == "comma":
            if sign == ",":
                want = "key" if isinstance(stack[-1][0], dict) else "value"
            elif sign == ("}" if isinstance(stack[-1][0], dict) else "]"):
                stack.pop()
                want = "comma" if stack else "end"
            else:
                raise ValueError(at)
            continue
        if want == "colon":
            if sign != ":":
                raise ValueError(at)
            want = "value"
            continue
        if want in ("key", "key-or-}"):
            if sign == "}" and want == "key-or-}":
                stack.pop()
                want = "comma" if stack else "end"
            elif m[2]:
                key, at = json.decoder.scanstring(text, at, True)
                stack[-1][1] = key
                want = "colon"
            else:
                raise ValueError(at)
            continue
        if sign == "]" and want == "value-or-]":
            stack.pop()
            want = "comma" if stack else "end"
            continue
        if sign == "{":
            value = {}
        elif sign == "[":
            value = []
        elif sign:
            raise ValueError(at)
        elif m[2]:
            value, at = json.decoder.scanstring(text, at, True)
        elif m[3]:
            value = _number(m[3]) if m[4] or m[5] else _integer(m[3])
        else:
            value = _WORDS[m[6]]
        if not stack:
            root.append(value)
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][stack[-1][1]] = value
        else:
            stack[-1][0].append(value)
        if sign:
            stack.append([value, None])
            want = "key-or-}" if sign == "{" else "value-or-]"
        else:
            want = "comma" if stack else "end"


def decode(text: str | None):
    """The value of a JSON text, or None where it isn't valid."""
    if not text or not (text := text.strip(" \t\n\r")):
        return None
    try:
        value, end = _DECODER.raw_decode(text)
        return value if end == len(text) else None
    except RecursionError:
        try:
            return _decode_deep(text)
        except (ValueError, IndexError):
            return None
    except ValueError:
        return None


def _clean(s: str) -> str:
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _scalar(value) -> tuple[str, str]:
    if value is None:
        return "null", ""
    if isinstance(value, str):
        return "string", _clean(value)
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    return "number", value.text if isinstance(value, Exact) else spelling(repr(value))


def identities(root) -> tuple[dict[int, bytes], list]:
    """Merkle identities of all containers (by ``id()``), bottom-up, and the containers in pre-order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(y for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (dict, list)))
    ids: dict[int, bytes] = {}
    for x in reversed(order):
        h = blake2b(digest_size=16)
        if isinstance(x, dict):
            h.update(b"o")
            for k in sorted(x):
                kb = _clean(k).encode()
                h.update(b"%d:" % len(kb) + kb)
                h.update(ids[id(v)] if isinstance(v := x[k], (dict, list)) else scalar_identity(v))
        else:
            h.update(b"a")
            for v in x:
                h.update(ids[id(v)] if isinstance(v, (dict, list)) else scalar_identity(v))
        ids[id(x)] = h.digest()
    return ids, order


def scalar_identity(value) -> bytes:
    kind, text = _scalar(value)
    return blake2b(f"{kind[:2]}{text}".encode(), digest_size=16).digest()


def leaves(value) -> list[tuple[str, str]]:
    """(path, text) of the non-null scalars within a value, such as ('$.edits[0].old', 'x')."""
    out, stack = [], [("$", value)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict):
            stack.extend((f"{path}.{_clean(k)}", v) for k, v in x.items())
        elif isinstance(x, list):
            stack.extend((f"{path}[{i}]", v) for i, v in enumerate(x))
        elif x is not None:
            out.append((path, _scalar(x)[1]))
    return out


def _text(x) -> str | None:
    return _clean(x) if isinstance(x, str) else None


def shred_one(payload: str | None, all_nodes: bool) -> dict | None:
    root = decode(payload)
    if not isinstance(root, dict) or not isinstance(root.get("uuid"), str) or not root["uuid"]:
        return None
    ids, _ = identities(root)
    messages, blocks, inputs = [], [], {}
    for n, m in enumerate(root.get("chat_messages") if isinstance(root.get("chat_messages"), list) else []):
        if not isinstance(m, dict):
            continue
        uuid = _text(m.get("uuid")) or ""
        messages.append({"message_uuid": uuid, "ordinal": n, "sender": _text(m.get("sender")), "object_id": ids[id(m)]})
        content = m.get("content")
        if isinstance(content, str):
            blocks.append({"message_uuid": uuid, "block_path": "0", "parent_path": "", "ordinal": 0, "block_type": "text", "tool_ref": "", "object_id": scalar_identity(content), "input_id": None})
        stack = [("", content)]
        while stack:
            above, content = stack.pop()
            for k, b in enumerate(content if isinstance(content, list) else []):
                if not isinstance(b, dict):
                    continue
                path, given = f"{above}.{k}" if above else str(k), b.get("input")
                one = None
                if given is not None:
                    one = ids[id(given)] if isinstance(given, (dict, list)) else scalar_identity(given)
                    if one not in inputs:
                        inputs[one] = {"input_id": one, "leaves": [{"path": p, "value": v} for p, v in leaves(given)]}
                ref = _text(b.get("id")) or _text(b.get("tool_use_id")) or ""
                blocks.append({"message_uuid": uuid, "block_path": path, "parent_path": above, "ordinal": k, "block_type": _text(b.get("type")) or "", "tool_ref": ref, "object_id": ids[id(b)], "input_id": one})
                stack.append((path, b.get("content")))
    nodes = []
    if all_nodes:
        stack = [(-1, None, 0, root)]
        while stack:
            parent, member, ordinal, x = stack.pop()
            me = len(nodes)
            if isinstance(x, (dict, list)):
                nodes.append({"node": me, "parent": parent, "member": member, "ordinal": ordinal, "object_id": ids[id(x)], "kind": "object" if isinstance(x, dict) else "array", "value": None})
                pairs = [(_clean(k), i, v) for i, (k, v) in enumerate(x.items())] if isinstance(x, dict) else [(None, i, v) for i, v in enumerate(x)]
                stack.extend((me, k, i, v) for k, i, v in reversed(pairs))
            else:
                kind, value = _scalar(x)
                nodes.append({"node": me, "parent": parent, "member": member, "ordinal": ordinal, "object_id": scalar_identity(x), "kind": kind, "value": value})
    return {"conversation_uuid": _clean(root["uuid"]), "root_id": ids[id(root)], "messages": messages, "blocks": blocks, "inputs": list(inputs.values()), "nodes": nodes}


def shred(records: DataFrame, key: str = "record_id", version: str = "exported_at", payload: str = "payload", all_nodes: bool = False) -> DataFrame:
    """One row of SHREDDED for each record that counts; lists of a record are those of its own tree."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(SHREDDED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                if (row := shred_one(text, all_nodes)) is not None:
                    rows.append({"record_id": batch.column(0)[i].as_py(), "exported_at": batch.column(1)[i].as_py(), **row})
                    chars += len(text)
                if chars > _FLUSH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    chosen = records.select(F.col(key).cast("bigint").alias("record_id"), F.col(version).cast("timestamp").alias("exported_at"), F.col(payload).cast("string").alias("payload"))
    return chosen.mapInArrow(run, schema)


def latest(shredded: DataFrame) -> DataFrame:
    """Of several records of one conversation the one of the latest export; of those the one of the largest key."""
    heads = shredded.select("conversation_uuid", F.struct("exported_at", "record_id").alias("v"))
    # grouped by key with partial aggregates: a conversation exported any number of times is no burden
    best = heads.groupBy("conversation_uuid").agg(F.max("v").alias("best"))
    n, kept = heads.count(), best.count()
    if n == kept:
        return shredded
    if n - kept <= BROADCAST_ROWS:
        lost = Stage(heads.join(best, "conversation_uuid").where("v != best").select(F.col("v.record_id").alias("record_id")).distinct()).df
        return shredded.join(F.broadcast(lost), "record_id", "left_anti")
    return shredded.join(best.select("best.record_id"), "record_id", "left_semi")


class NestedTables:
    """The flat tables of nested records, as lazy DataFrames over one written pass."""

    def __init__(self, records: DataFrame, key: str = "record_id", version: str = "exported_at", payload: str = "payload", all_nodes: bool = False):
        self.rows = latest(Stage(shred(records, key, version, payload, all_nodes)).df)

    def conversations(self) -> DataFrame:
        return self.rows.select("conversation_uuid", "record_id", "exported_at", "root_id", F.size("messages").alias("n_messages"))

    def messages(self) -> DataFrame:
        return self.rows.select("conversation_uuid", F.inline("messages"))

    def blocks(self) -> DataFrame:
        return self.rows.select("conversation_uuid", F.inline("blocks"))

    def inputs(self) -> DataFrame:
        """Distinct inputs, each with its leaves, whatever the number of blocks that have it."""
        return self.rows.select(F.inline("inputs")).groupBy("input_id").agg(F.first("leaves").alias("leaves"))

    def input_values(self) -> DataFrame:
        return self.inputs().select("input_id", F.inline("leaves"))

    def occurrences(self) -> DataFrame:
        """The bridge: one row for each place where a value stands, with its parent and ordinal."""
        return self.rows.select("record_id", F.inline("nodes"))

    def objects(self) -> DataFrame:
        """Distinct values, each stored once, with the number of their occurrences."""
        return self.occurrences().groupBy("object_id").agg(F.first("kind").alias("kind"), F.first("value").alias("value"), F.count("*").alias("n_occurrences"))

    def tool_links(self) -> DataFrame:
        """Pairs of a tool_use block and the blocks with its tool_use_id in the same conversation."""
        b = self.blocks().where("tool_ref != ''")
        use = b.where("block_type = 'tool_use'").select("conversation_uuid", "tool_ref", F.col("message_uuid").alias("use_message_uuid"), F.col("block_path").alias("use_path"))
        got = b.where("block_type = 'tool_result'").select("conversation_uuid", "tool_ref", F.col("message_uuid").alias("result_message_uuid"), F.col("block_path").alias("result_path"))
        return use.join(got, ["conversation_uuid", "tool_ref"], "left").distinct()
