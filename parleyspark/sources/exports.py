"""Reading what archives are imported from: export files, local session logs, code-session dumps."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NOT_BLANK = lambda c: F.nullif(c, F.lit(""))


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of export files that each hold one JSON array: conversations, messages, content_blocks.

    Members may be absent or null; a file that isn't an array gives no rows, nor does an element that isn't an object or can't be
    read. Unions of types (text or list) are read as VARIANT, never inferred.
    """
    return export_tables(read_array_items(spark, path).select(F.try_parse_json("value").alias("c")).where("c is not null"))


#: Characters of a file held at once, besides one element.
_PIECE_CHARS = 1 << 20
_MARK = re.compile(r'["\\{}\[\]]|,')


def array_items(pieces: Iterator[str]) -> Iterator[str]:
    """The elements of a JSON array, as texts, from pieces of its text; ValueError where it isn't one array. Only one element is held."""
    depth, quoted, held, skip, seen = 0, False, [], False, False
    for piece in pieces:
        start, at = 0, 1 if skip else 0
        skip = False
        while m := _MARK.search(piece, at):
            at, c = m.end(), m[0]
            if quoted:
                if c == "\\":
                    skip = at == len(piece)
                    at += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "[{":
                if not depth and ("".join([*held, piece[start : m.start()]]).strip() or seen or c == "{"):
                    raise ValueError("not one array")
                depth += 1
                if depth == 1:
                    held, start, seen = [], at, True
            elif c in "]}":
                depth -= 1
                if depth < 0 or (not depth and c == "}"):
                    raise ValueError("unbalanced")
                if not depth:
                    if item := "".join([*held, piece[start : m.start()]]).strip():
                        yield item
                    held, start = [], at
            elif c == "," and depth == 1:
                yield "".join([*held, piece[start : m.start()]]).strip()
                held, start = [], at
        held.append(piece[start:])
    if depth or quoted or not seen or "".join(held).strip():
        raise ValueError("not one array")


def read_array_items(spark: SparkSession, path: str) -> DataFrame:
    """(value): a row for each element of the JSON arrays in files below a folder, whatever the size of a file.

    A task streams its files twice: once to see that the brackets close, and once for the elements, of which it holds one
    at a time. A file that isn't one array gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path).select("path")

    def pieces(url: str) -> Iterator[str]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", url))
        with system.open_input_stream(name) as raw, io.TextIOWrapper(raw, encoding="utf-8", errors="replace") as f:
            while piece := f.read(_PIECE_CHARS):
                yield piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url in b.column(0).to_pylist():
                try:
                    for _ in array_items(pieces(url)):
                        pass
                except ValueError:
                    continue
                held, size = [], 0
                for item in array_items(pieces(url)):
                    held.append(item)
                    size += len(item)
                    if size > 4 * _PIECE_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return files.mapInArrow(run, "value string")


def _s(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def export_tables(items: DataFrame) -> dict[str, DataFrame]:
    """The tables of a DataFrame with one VARIANT column ``c`` of conversations."""
    c = items.withColumn("uuid", _s("c", "$.uuid")).where("uuid is not null and uuid != ''")
    conversations = c.select("uuid", _s("c", "$.name").alias("name"), _s("c", "$.summary").alias("summary"), _s("c", "$.created_at").alias("created_at"), _s("c", "$.updated_at").alias("updated_at"), _s("c", "$.account.uuid").alias("account_uuid"))
    m = c.select(F.col("uuid").alias("conversation_uuid"), F.explode(F.try_variant_get("c", "$.chat_messages", "array<variant>")).alias("m"))
    m = m.withColumn("uuid", _s("m", "$.uuid")).where("uuid is not null")
    messages = m.select(
        "uuid", "conversation_uuid", _s("m", "$.sender").alias("sender"), _NOT_BLANK(_s("m", "$.text")).alias("text"), _s("m", "$.created_at").alias("created_at"), _s("m", "$.updated_at").alias("updated_at"), _s("m", "$.parent_message_uuid").alias("parent_message_uuid"),
        F.coalesce(F.to_json(F.try_variant_get("m", "$.attachments", "variant")), F.lit("[]")).alias("attachments"), F.coalesce(F.to_json(F.try_variant_get("m", "$.files", "variant")), F.lit("[]")).alias("files"),
    )
    b = m.select(F.col("uuid").alias("message_uuid"), "conversation_uuid", F.posexplode(F.try_variant_get("m", "$.content", "array<variant>")).alias("block_index", "b"))
    return {"conversations": conversations, "messages": messages, "content_blocks": blocks(b)}


def blocks(b: DataFrame) -> DataFrame:
    """Normalised content blocks of (message_uuid, conversation_uuid, block_index, b VARIANT)."""
    # a result's text is its content, or the texts of its blocks line by line
    parts = F.array_join(F.filter(F.transform(F.try_variant_get("b", "$.content", "array<variant>"), lambda x: _s(x, "$.text")), lambda x: x.isNotNull()), "\n")
    result = F.when(_s("b", "$.type") == "tool_result", F.coalesce(F.when(F.schema_of_variant(F.try_variant_get("b", "$.content", "variant")).startswith("STRING"), _s("b", "$.content")), parts))
    text = F.coalesce(_NOT_BLANK(_s("b", "$.text")), _NOT_BLANK(_s("b", "$.thinking")), _NOT_BLANK(result))
    return b.where(_s("b", "$.type").isNotNull()).select(
        "message_uuid", "conversation_uuid", "block_index", _s("b", "$.type").alias("block_type"), text.alias("text_content"), _NOT_BLANK(_s("b", "$.name")).alias("tool_name"),
        F.coalesce(_NOT_BLANK(_s("b", "$.id")), _NOT_BLANK(_s("b", "$.tool_use_id"))).alias("tool_use_id"), F.to_json(F.try_variant_get("b", "$.input", "variant")).alias("tool_input"),
        F.try_variant_get("b", "$.is_error", "boolean").cast("int").alias("is_error"), F.to_json("b").alias("meta"),
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Entries of session logs (JSON lines): (session, line, uuid, parent_uuid, type, created_at, cwd, version, content VARIANT).

    Blank and broken lines and entries of other types are left out; ``line`` is the place in the file.
    """
    t = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    t = t.withColumn("j", F.try_parse_json(F.trim("value"))).where("j is not null").withColumn("type", _s("j", "$.type")).where("type in ('user', 'assistant')")
    session = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    return t.select(session.alias("session"), "line", _s("j", "$.uuid").alias("uuid"), _s("j", "$.parentUuid").alias("parent_uuid"), "type", _s("j", "$.timestamp").alias("created_at"), _NOT_BLANK(_s("j", "$.cwd")).alias("cwd"), _NOT_BLANK(_s("j", "$.version")).alias("version"), F.try_variant_get("j", "$.message.content", "variant").alias("content"))


def content_text(content: Column, kind: Column) -> Column:
    """Text of a message: itself if a string, else its text blocks, trimmed, joined by one line break (user) or two."""
    parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.when(_s(b, "$.type") == "text", F.trim(_s(b, "$.text")))), lambda x: x.isNotNull() & (x != ""))
    plain = F.when(F.schema_of_variant(content).startswith("STRING"), _s(content, "$"))
    return F.coalesce(plain, F.when(kind == "user", F.array_join(parts, "\n")).otherwise(F.array_join(parts, "\n\n")), F.lit(""))


def session_tables(entries: DataFrame) -> dict[str, DataFrame]:
    """Sessions as conversations, with messages and blocks: uuid = file name, title = first line of the first question, cut at 80."""
    e = entries.withColumn("text", content_text(F.col("content"), F.col("type")))
    first = F.min(F.when((F.col("type") == "user") & (F.schema_of_variant("content").startswith("STRING")), F.struct("line", "text"))).alias("f")
    s = e.groupBy("session").agg(first, F.min_by("created_at", "line").alias("created_at"), F.max_by("created_at", "line").alias("updated_at"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line"))).alias("summary"))
    line = F.trim(F.element_at(F.split(F.trim("f.text"), "\n"), 1))
    title = F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 80), F.lit("…"))).otherwise(line)
    conversations = s.select(F.col("session").alias("uuid"), F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Session "), F.substring("session", 1, 8))).alias("name"), "summary", "created_at", "updated_at", F.lit("local").alias("account_uuid"))
    messages = e.select("uuid", F.col("session").alias("conversation_uuid"), F.when(F.col("type") == "user", "human").otherwise("assistant").alias("sender"), "text", "created_at", F.col("created_at").alias("updated_at"), F.col("parent_uuid").alias("parent_message_uuid"))
    b = e.select(F.col("uuid").alias("message_uuid"), F.col("session").alias("conversation_uuid"), F.posexplode(F.try_variant_get("content", "$", "array<variant>")).alias("block_index", "b"))
    plain = e.where(F.schema_of_variant("content").startswith("STRING")).select(
        F.col("uuid").alias("message_uuid"), F.col("session").alias("conversation_uuid"), F.lit(0).alias("block_index"), F.lit("text").alias("block_type"), F.trim("text").alias("text_content"), *[F.lit(None).cast(t).alias(c) for c, t in (("tool_name", "string"), ("tool_use_id", "string"), ("tool_input", "string"), ("is_error", "int"), ("meta", "string"))]
    )
    return {"conversations": conversations, "messages": messages, "content_blocks": blocks(b).unionByName(plain)}


def import_new(existing: DataFrame, found: dict[str, DataFrame], force: bool = False) -> dict[str, DataFrame]:
    """Only the sessions that ``existing`` (uuid) hasn't; all with ``force``, after whose rows have been deleted."""
    if force:
        return found
    old = existing.select("uuid")
    return {k: t.join(old if k == "conversations" else old.withColumnRenamed("uuid", "conversation_uuid"), "uuid" if k == "conversations" else "conversation_uuid", "left_anti") for k, t in found.items()}


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Messages of code-session dumps, each with the one before it as parent, and the number of events of each type left out.

    The events are a list, or a list under data, events or items.
    """
    messages, skipped, _ = _dump(spark, path)
    return messages, skipped


def _dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.try_parse_json("value").alias("j"))
    events = F.coalesce(*[F.try_variant_get("j", p, "array<variant>") for p in ("$.events", "$.events.data", "$.events.events", "$.events.items")])
    t = files.select(F.coalesce(_s("j", "$.meta.id"), _s("j", "$.meta.uuid")).alias("session"), F.posexplode(events).alias("pos", "e"))
    t = t.select("session", "pos", _s("e", "$.type").alias("type"), F.coalesce(_s("e", "$.uuid"), _s("e", "$.id"), F.concat_ws("-", "session", "pos")).alias("uuid"), F.coalesce(_s("e", "$.created_at"), _s("e", "$.timestamp")).alias("created_at"), _s("e", "$.message.role").alias("role"), F.try_variant_get("e", "$.message.content", "variant").alias("content"))
    kept = (F.col("type").isin("user", "assistant")) & F.col("role").isNotNull()
    before = F.lag("uuid").over(Window.partitionBy("session").orderBy("pos"))
    messages = t.where(kept).select("uuid", F.col("session").alias("conversation_uuid"), F.col("role").alias("sender"), flat_text(F.col("content")).alias("text"), "created_at", before.alias("parent_message_uuid"))
    skipped = t.where(~kept).groupBy("type").agg(F.count("*").alias("n_events"))
    b = t.where(kept).select(F.col("uuid").alias("message_uuid"), F.col("session").alias("conversation_uuid"), F.posexplode(F.try_variant_get("content", "$", "array<variant>")).alias("block_index", "b"))
    return messages, skipped, blocks(b)


def dump_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Messages and content blocks of code-session dumps, ready to be stored: blocks of a message that comes again take the place of the old ones."""
    messages, _, blocks_ = _dump(spark, path)
    return {"messages": messages, "content_blocks": blocks_}


def flat_text(content: Column) -> Column:
    """A message's content as text: texts, thoughts, [tool_use:NAME] and [tool_result] lines, two line breaks apart."""
    def one(b: Column) -> Column:
        kind = _s(b, "$.type")
        sub = F.array_join(F.filter(F.transform(F.try_variant_get(b, "$.content", "array<variant>"), lambda x: _s(x, "$.text")), lambda x: x.isNotNull()), "\n")
        got = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(b, "$.content", "variant")).startswith("STRING"), _s(b, "$.content")), sub, F.lit(""))
        return F.when(kind == "text", _s(b, "$.text")).when(kind == "thinking", _s(b, "$.thinking")).when(kind == "tool_use", F.concat(F.lit("[tool_use:"), F.coalesce(_s(b, "$.name"), F.lit("")), F.lit("]"))).when(kind == "tool_result", F.concat(F.lit("[tool_result] "), got))

    parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), one), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.when(F.schema_of_variant(content).startswith("STRING"), _s(content, "$")), F.array_join(parts, "\n\n"), F.lit(""))


def readout(events: DataFrame) -> DataFrame:
    """Histogram of entry types and tools of session entries: (kind, value, n)."""
    kinds = events.groupBy(F.lit("type").alias("kind"), F.col("type").alias("value")).agg(F.count("*").alias("n"))
    tools = events.select(F.explode(F.try_variant_get("content", "$", "array<variant>")).alias("b")).where(_s("b", "$.type") == "tool_use").groupBy(F.lit("tool").alias("kind"), _s("b", "$.name").alias("value")).agg(F.count("*").alias("n"))
    return kinds.unionByName(tools)


def find_sessions(spark: SparkSession, path: str, name: str = "") -> DataFrame:
    """(session, project, file) of the logs below a folder whose name begins with ``name``; ``session_`` before it is ignored."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path).select(F.col("path").alias("file"))
    t = t.select(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("session"), F.regexp_extract("file", r"([^/]+)/[^/]+\.jsonl$", 1).alias("folder"), "file")
    project = F.regexp_replace(F.regexp_replace("folder", "--", "/"), "^-", "/")
    return t.where(F.col("session").startswith(name.removeprefix("session_"))).select("session", project.alias("project"), "file")


def linear_sessions(entries: DataFrame, tools: bool = False, thinking: bool = False, limit: int | None = None) -> DataFrame:
    """(session, place, uuid, role, text): each session from its first root on to the latest child; all entries in their
    order where that covers less than half of more than two. Tool calls and thoughts stand in the text if asked for."""
    from parleyspark.functions.keys import pack_key
    from parleyspark.operators.hierarchy import point_at_roots
    from parleyspark.plans.stage import Stage

    def shown(b: Column) -> Column:
        kind = _s(b, "$.type")
        out = F.when(kind == "text", _s(b, "$.text"))
        if thinking:
            out = out.when(kind == "thinking", _s(b, "$.thinking"))
        if tools:
            out = out.when(kind == "tool_use", F.concat(F.lit("[tool_use:"), F.coalesce(_s(b, "$.name"), F.lit("")), F.lit("]")))
        return out

    parts = F.array_join(F.filter(F.transform(F.try_variant_get("content", "$", "array<variant>"), shown), lambda x: x.isNotNull() & (x != "")), "\n\n")
    text = F.coalesce(F.when(F.schema_of_variant("content").startswith("STRING"), _s("content", "$")), parts, F.lit(""))
    e = entries.where("uuid is not null").select("session", "line", "uuid", "parent_uuid", F.col("type").alias("role"), text.alias("text"))
    e = Stage(e.withColumn("id", pack_key(F.concat_ws("/", "session", "uuid"))).withColumn("up", F.when(F.col("parent_uuid").isNotNull(), pack_key(F.concat_ws("/", "session", "parent_uuid")))).dropDuplicates(["id"])).df
    best = e.where("up is not null").groupBy("up").agg(F.max(F.struct("line", "id")).alias("b")).select(F.col("b.id").alias("id"), F.lit(True).alias("best"))
    walked = point_at_roots(e.join(best, "id", "left").select("id", F.col("up").alias("parent"), (F.col("up").isNull() | F.col("best").eqNullSafe(True)).alias("ok")))
    first = e.where("up is null").groupBy("session").agg(F.min(F.struct("line", "id")).alias("f")).select("session", F.col("f.id").alias("start"))
    t = e.join(walked, "id").join(first, "session", "left").withColumn("on", F.coalesce(F.col("ok") & (F.col("root") == F.col("start")), F.lit(False)))
    share = t.groupBy("session").agg(F.count_if("on").alias("n_on"), F.count("*").alias("n"))
    t = t.join(share.select("session", ((F.col("n") <= 2) | (2 * F.col("n_on") >= F.col("n"))).alias("tree")), "session").where("on or not tree")
    order = F.when(F.col("tree"), F.col("depth")).otherwise(F.col("line"))
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(order, "line")))
    return (t.where(F.col("place") <= limit) if limit else t).select("session", "place", "uuid", "role", "text")


def session_summary(entries: DataFrame) -> DataFrame:
    """(session, n_prompts, first_reply, last_reply): prompts of people, not those made by machines, and the answers at both ends."""
    e = entries.withColumn("text", content_text(F.col("content"), F.col("type")))
    real = (F.col("type") == "user") & (F.trim("text") != "") & ~F.col("text").contains("<task-notification>") & ~F.col("text").startswith("Tool loaded")
    said = (F.col("type") == "assistant") & (F.col("text") != "")
    return e.groupBy("session").agg(F.count_if(real).alias("n_prompts"), F.min_by("text", F.when(said, F.col("line"))).alias("first_reply"), F.max_by("text", F.when(said, F.col("line"))).alias("last_reply"))
