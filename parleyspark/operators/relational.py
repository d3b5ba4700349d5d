"""Lookups, filters and statistics over the canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.functions.text import descriptor
from parleyspark.operators.entities import TOPICS
from parleyspark.sources.archive import Archive

NIL = "00000000-0000-4000-8000-000000000000"


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def search_conversations(a: Archive, query: str = "", after: str | None = None, before: str | None = None, limit: int | None = None) -> DataFrame:
    """Titles that hold ``query``, whatever the case; newest first when limited. Bounds that are no instants raise."""
    t = a.conversations
    if query:
        t = t.where(F.lower("name").contains(query.lower()))
    for bound, keep in ((after, lambda x: F.col("created") >= x), (before, lambda x: F.col("created") <= x)):
        if bound:
            t = t.where(keep(F.lit(bound).cast("timestamp")))
    t = t.select("uuid", "name", "created_at", "updated_at", "updated")
    return (t.orderBy(F.desc_nulls_last("updated"), "uuid").limit(limit) if limit else t).drop("updated")


def untitled(a: Archive, limit: int | None = None) -> DataFrame:
    n = a.messages.groupBy(F.col("conversation_uuid").alias("uuid")).agg(F.count("*").alias("n"))
    t = a.conversations.where(blank("name")).join(n, "uuid", "left").select("uuid", "created_at", "updated_at", F.coalesce("n", F.lit(0)).alias("message_count"), "updated")
    return (t.orderBy(F.desc_nulls_last("updated"), "uuid").limit(limit) if limit else t).drop("updated")


def empty(a: Archive) -> DataFrame:
    m = a.raw("messages").select(F.col("conversation_uuid").alias("uuid")).distinct()
    return a.conversations.join(m, "uuid", "left_anti").select("uuid", "name", "created_at", "updated_at")


def audit(a: Archive) -> DataFrame:
    m = a.raw("messages").select(F.col("conversation_uuid").alias("uuid")).distinct().withColumn("has", F.lit(True))
    t = a.conversations.select("uuid", "name").join(m, "uuid", "left")
    t = t.agg(F.count("*").alias("total"), F.count_if(blank("name")).alias("untitled"), F.count_if(F.col("has").isNull()).alias("empty"))
    share = lambda c: F.round(100 * F.col(c) / F.nullif(F.col("total"), F.lit(0)), 1)
    return t.select("total", "untitled", "empty", share("untitled").alias("untitled_percent"), share("empty").alias("empty_percent"))


def edit_histories(a: Archive) -> DataFrame:
    """For every message: itself and the messages that continue it, (message_uuid, version_uuid, created_at)."""
    m = a.messages.select("uuid", "parent_message_uuid", "created_at")
    own = m.select(F.col("uuid").alias("message_uuid"), F.col("uuid").alias("version_uuid"), "created_at")
    ids = m.select(F.col("uuid").alias("message_uuid"))
    below = m.where("parent_message_uuid is not null").select(F.col("parent_message_uuid").alias("message_uuid"), F.col("uuid").alias("version_uuid"), "created_at").join(ids, "message_uuid", "left_semi")
    return own.unionByName(below.where("message_uuid != version_uuid"))


def edit_history(a: Archive, message: str) -> DataFrame:
    return a.messages.where((F.col("uuid") == message) | (F.col("parent_message_uuid") == message)).orderBy("created", "uuid")


def sibling_counts(a: Archive) -> DataFrame:
    """(message_uuid, n_siblings), the message itself included; messages without a parent have none."""
    m = a.messages.where("parent_message_uuid is not null").select(F.col("uuid").alias("message_uuid"), "parent_message_uuid")
    n = m.groupBy("parent_message_uuid").agg(F.count("*").alias("n_siblings"))
    return m.join(n, "parent_message_uuid").select("message_uuid", "n_siblings")


def siblings(a: Archive, message: str) -> DataFrame:
    parent = a.messages.where(F.col("uuid") == message).select("parent_message_uuid")
    return a.messages.join(parent, "parent_message_uuid", "left_semi").orderBy("created", "uuid")


def conversation_messages(a: Archive, conversation: str) -> DataFrame:
    return a.messages.where(F.col("conversation_uuid") == conversation).orderBy("created", "uuid")


def first_messages(a: Archive, n: int = 60, chars: int = 280) -> DataFrame:
    """The first n messages of each conversation, white space collapsed, texts cut."""
    w = Window.partitionBy("conversation_uuid").orderBy(F.asc_nulls_first("created"), "uuid")
    cut = F.substring(F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")), 1, chars).alias("text")
    t = a.messages_with("conversation_uuid", "created", "sender", cut).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return t.select("conversation_uuid", "place", "uuid", "sender", "text")


def topic_scan(a: Archive, topics: list[str] = TOPICS) -> DataFrame:
    """(topic, n_messages): messages whose text holds the topic, ASCII case ignored; one pass, topics without any included."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # the topics of a text are found where it is read
    held = F.transform(F.array(*map(F.lit, [x.lower() for x in topics])), lambda x: F.contains(text, x)).alias("held")
    counts = a.messages_with(held).agg(*[F.count_if(F.col("held")[i]).alias(f"c{i}") for i in range(len(topics))])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("topic"), F.col(f"c{i}").alias("n_messages")) for i, x in enumerate(topics)])).alias("x")).select("x.*")


def attachment_search(a: Archive, query: str, per_conversation: int | None = None) -> DataFrame:
    """Messages whose attachments, in canonical JSON (raw where it can't be read), hold the query."""
    held = a.messages.where(~blank("attachments") & (F.col("attachments") != "[]"))
    text = F.lower(F.coalesce(F.to_json(F.try_parse_json("attachments")), F.col("attachments")))
    t = held.where(text.contains(query.lower()))
    if per_conversation:
        w = Window.partitionBy("conversation_uuid").orderBy(F.asc_nulls_first("created"), "uuid")
        t = t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_conversation)
    return t.select("uuid", "conversation_uuid", "created_at")


_ATTACHMENT = "array<struct<file_name:string,file_type:string,file_size:bigint,extracted_content:string>>"


def attachments(a: Archive, chars: int = 2000) -> DataFrame:
    """Attachments with text: (message_uuid, place from 1, file_name, file_type, file_size, content)."""
    held = a.messages.where(~blank("attachments") & (F.col("attachments") != "[]"))
    t = held.select(F.col("uuid").alias("message_uuid"), F.posexplode(F.from_json("attachments", _ATTACHMENT)).alias("i", "x"))
    return t.where("x.extracted_content is not null and x.extracted_content != ''").select(
        "message_uuid", (F.col("i") + 1).cast("bigint").alias("place"), "x.file_name", "x.file_type", "x.file_size", F.substring("x.extracted_content", 1, chars).alias("content")
    )


def artifacts(a: Archive, chars: int = 3000) -> DataFrame:
    """Documents that tool calls created: (id, message_uuid, title, content)."""
    t = a.blocks.where("block_type = 'tool_use' and tool_name = 'artifacts'")
    get = lambda k: F.get_json_object("tool_input", f"$.{k}")
    t = t.select("id", "message_uuid", get("command").alias("command"), get("title").alias("title"), get("content").alias("content"))
    return t.where("command = 'create' and content is not null and content != ''").select("id", "message_uuid", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), F.substring("content", 1, chars).alias("content"))


SOURCE_ENDINGS = ("pdf", "doc", "docx", "txt", "md", "xlsx", "csv", "json", "xml")


def file_category(name: Column, sender: Column) -> Column:
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(sender == "assistant", "generated").when(ending.isin(*SOURCE_ENDINGS), "sources").otherwise("photos")


def version_folder(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.startswith("page_"), "v01").when(n.startswith("v2_"), "v02").when(n.startswith("v3_"), "v03").when(n.startswith("v4_"), "v04").otherwise("v05-latest")


_FILE = "array<struct<file_uuid:string,file_name:string,file_kind:string,created_at:string>>"


def conversation_files(a: Archive) -> DataFrame:
    """Files of messages, each file_uuid once for a conversation: (conversation_uuid, file_uuid, file_name, category, folder, date, sequence).

    The first message that has a file says who sent it; the sequence counts the files of one descriptor of titles and one date.
    """
    t = a.messages_with("conversation_uuid", "sender", "created", F.from_json("files", _FILE).alias("files")).withColumnRenamed("created", "at")
    t = t.select("conversation_uuid", "uuid", "sender", "at", F.posexplode("files").alias("pos", "f")).where("f.file_uuid is not null and f.file_uuid != ''")
    t = t.groupBy("conversation_uuid", F.col("f.file_uuid").alias("file_uuid")).agg(F.min(F.struct(F.coalesce(F.unix_millis("at"), F.lit(-1)).alias("at"), "uuid", "pos", "sender", "f")).alias("first"))
    name = F.coalesce("first.f.file_name", F.lit(""))
    who = F.when(F.col("first.sender") == "human", "human").otherwise("assistant")
    c = a.conversations.select(F.col("uuid").alias("conversation_uuid"), descriptor(F.coalesce("name", F.lit(""))).alias("descriptor"))
    t = t.join(c, "conversation_uuid", "left").withColumn("date", F.substring("first.f.created_at", 1, 10))
    seq = Window.partitionBy("descriptor", "date").orderBy("conversation_uuid", "first.at", "first.uuid", "first.pos")
    return t.select("conversation_uuid", "file_uuid", name.alias("file_name"), file_category(name, who).alias("category"), version_folder(name).alias("folder"), "date", F.row_number().over(seq).cast("bigint").alias("sequence"))


def file_manifest(a: Archive) -> DataFrame:
    """Attached files, each name once for a conversation, with category and sequence within (conversation, date)."""
    t = a.messages.where(~blank("attachments") & (F.col("attachments") != "[]")).select(
        "conversation_uuid", "uuid", "sender", "created", F.substring("created_at", 1, 10).alias("date"), F.inline(F.from_json("attachments", _ATTACHMENT))
    )
    first = Window.partitionBy("conversation_uuid", "file_name").orderBy(F.asc_nulls_first("created"), "uuid")
    t = t.where("file_name is not null").withColumn("k", F.row_number().over(first)).where("k = 1")
    seq = Window.partitionBy("conversation_uuid", "date").orderBy(F.asc_nulls_first("created"), "uuid", "file_name")
    return t.select("conversation_uuid", "file_name", file_category(F.col("file_name"), F.col("sender")).alias("category"), version_folder(F.col("file_name")).alias("folder"), "date", F.row_number().over(seq).cast("bigint").alias("sequence"))


def search_tool(a: Archive, tool: str) -> DataFrame:
    """Calls and results of a tool with the conversation's name, (id, message_uuid, conversation_uuid, name, block_type)."""
    t = a.blocks.where((F.col("tool_name") == tool) & F.col("block_type").isin("tool_use", "tool_result"))
    m = a.messages.select(F.col("uuid").alias("message_uuid"))
    c = a.conversations.select(F.col("uuid").alias("conversation_uuid"), "name")
    return t.join(m, "message_uuid", "left_semi").join(c, "conversation_uuid").select("id", "message_uuid", "conversation_uuid", "name", "block_type")


def search_tool_grouped(a: Archive, tool: str, snippets: int = 3, limit: int | None = None) -> DataFrame:
    """Conversations with calls or results of a tool; newest snippets first, their text is the block's."""
    m = a.messages_with("sender", "created_at", "created").withColumnRenamed("uuid", "message_uuid")
    text = a.block_versions().select("id", F.substring("text_content", 1, 200).alias("text")).dropDuplicates(["id"])
    hits = search_tool(a, tool).select("id", "message_uuid", "conversation_uuid").join(m, "message_uuid").join(text, "id")
    return grouped(a, hits.withColumnRenamed("id", "hit"), [F.desc_nulls_last("created"), "hit"], snippets, limit)


def grouped(a: Archive, hits: DataFrame, order: list, snippets: int, limit: int | None = None) -> DataFrame:
    """(conversation_uuid, name, project_uuid, project_name, created_at, hit_count, top_snippets) of hits (conversation_uuid, hit, sender, text, created_at, ...).

    The snippets are the first hits of each conversation in the given order, (sender, text, created_at). Ranks limit before
    the shuffle, so that a conversation with any number of hits is no burden. Conversations that aren't there give no row; with
    ``limit`` those of most hits come, in order. Tables without projects, or conversations without one, give NULL.
    """
    top = hits.withColumn("r", F.row_number().over(Window.partitionBy("conversation_uuid").orderBy(*order))).where(F.col("r") <= snippets)
    top = top.groupBy("conversation_uuid").agg(F.array_sort(F.collect_list(F.struct("r", "sender", "text", "created_at"))).alias("top"))
    n = hits.groupBy("conversation_uuid").agg(F.count("*").alias("hit_count"))
    c = with_project(a, a.conversations.withColumnRenamed("uuid", "conversation_uuid")).select("conversation_uuid", "name", "project_uuid", "project_name", "created_at")
    out = n.join(top, "conversation_uuid").join(c, "conversation_uuid")
    out = out.select("conversation_uuid", "name", "project_uuid", "project_name", "created_at", "hit_count", F.transform("top", lambda x: F.struct(x["sender"], x["text"], x["created_at"])).alias("top_snippets"))
    return out.orderBy(F.desc("hit_count"), "conversation_uuid").limit(limit) if limit else out


def with_project(a: Archive, conversations: DataFrame) -> DataFrame:
    """Conversations with project_uuid and project_name, NULL where the archive has no such column or no such table."""
    t = conversations.withColumn("project_uuid", optional(conversations, "project_uuid"))
    if not a.has("projects"):
        return t.withColumn("project_name", F.lit(None).cast("string"))
    p = a.projects.select(F.col("uuid").alias("project_uuid"), F.col("name").alias("project_name"))
    return t.join(p, "project_uuid", "left")


def search_entity(a: Archive, entity: str, kind: str | None = None) -> DataFrame:
    t = a.entities.where(F.col("entity") == entity.lower())
    if kind:
        t = t.where(F.col("type") == kind)
    m = a.messages.select(F.col("uuid").alias("message_uuid"), "sender", "created_at", "created")
    c = a.conversations.select(F.col("uuid").alias("conversation_uuid"), "name")
    return t.join(m, "message_uuid").join(c, "conversation_uuid").select("entity", "type", "message_uuid", "conversation_uuid", "name", "sender", "created_at", "created")


def search_entity_grouped(a: Archive, entity: str, kind: str | None = None, snippets: int = 3, limit: int | None = None) -> DataFrame:
    """Conversations with messages that mention the entity; newest snippets first."""
    m = a.messages_with(F.substring("text", 1, 200).alias("text")).withColumnRenamed("uuid", "message_uuid")
    hits = search_entity(a, entity, kind).join(m, "message_uuid").withColumnRenamed("message_uuid", "hit")
    return grouped(a, hits, [F.desc_nulls_last("created"), "hit"], snippets, limit)


def message_totals(a: Archive) -> DataFrame:
    """The counts of the archive, tall: (metric, value DOUBLE)."""
    c = a.conversations.agg(F.count("*").alias("conversations"), F.count_if(blank("name")).alias("untitled"), F.count_if(~blank("project_uuid")).alias("with_project"))
    m = a.messages.agg(F.count("*").alias("messages"), F.count_if(F.col("sender") == "human").alias("human_messages"), F.count_if(F.col("sender") == "assistant").alias("assistant_messages"))
    b = a.blocks.agg(F.count("*").alias("content_blocks"), F.count_if(F.col("block_type") == "thinking").alias("thinking_blocks"))
    e = a.entities.agg(F.count("*").alias("entities"))
    n = empty(a).agg(F.count("*").alias("empty"))
    # single rows
    one = reduce(lambda x, y: x.join(F.broadcast(y)), [c, m, b, e, n])
    one = one.withColumn("messages_per_conversation", F.round(F.col("messages") / F.nullif(F.col("conversations"), F.lit(0)), 1)).withColumn("thinking_per_assistant", F.round(F.col("thinking_blocks") / F.nullif(F.col("assistant_messages"), F.lit(0)), 2))
    return one.select([F.col(x).cast("double").alias(x) for x in one.columns]).unpivot([], one.columns, "metric", "value")


def monthly_activity(a: Archive, months: int | None = None) -> DataFrame:
    t = a.messages.where("created is not null").groupBy(F.date_format("created", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_messages"))
    return t.orderBy(F.desc("month")).limit(months) if months else t


def top_conversations(a: Archive, limit: int = 10) -> DataFrame:
    n = a.messages.groupBy(F.col("conversation_uuid").alias("uuid")).agg(F.count("*").alias("n_messages"))
    return a.conversations.select("uuid", "name").join(n, "uuid").orderBy(F.desc("n_messages"), "uuid").limit(limit)


def top_tools(a: Archive, limit: int = 10) -> DataFrame:
    t = a.blocks.where((F.col("block_type") == "tool_use") & ~blank("tool_name"))
    return t.groupBy("tool_name").agg(F.count("*").alias("n_calls")).orderBy(F.desc("n_calls"), "tool_name").limit(limit)


def date_range(a: Archive) -> DataFrame:
    return a.messages.agg(F.min("created").alias("first"), F.max("created").alias("last")).select(F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"))


def structure(a: Archive) -> DataFrame:
    """Structural metrics of every conversation that has messages or blocks."""
    held = ~blank("attachments") & (F.col("attachments") != "[]")
    m = a.messages.groupBy("conversation_uuid").agg(
        F.count("*").alias("message_count"), F.count_if(F.col("sender") == "human").alias("human_messages"), F.count_if(F.col("sender") == "assistant").alias("assistant_messages"),
        F.count_if(held).alias("attachment_count"), F.greatest(F.lit(0), (F.max(F.unix_millis("created")) - F.min(F.unix_millis("created")))).alias("ms"),
    )
    kids = a.messages.where("parent_message_uuid is not null").groupBy("conversation_uuid", "parent_message_uuid").agg(F.count("*").alias("n")).where("n > 1")
    kids = kids.groupBy("conversation_uuid").agg(F.count("*").alias("branch_points"))
    kind = F.col("block_type")
    b = a.blocks.groupBy("conversation_uuid").agg(
        F.count_if(kind == "tool_use").alias("tool_invocations"), F.count_if((kind == "tool_result") & (F.col("is_error") == 1)).alias("tool_errors"), F.count_if(kind == "thinking").alias("thinking_blocks")
    )
    t = m.join(kids, "conversation_uuid", "left").join(b, "conversation_uuid", "full")
    counts = ["message_count", "human_messages", "assistant_messages", "attachment_count", "branch_points", "tool_invocations", "tool_errors", "thinking_blocks"]
    return t.select("conversation_uuid", *[F.coalesce(x, F.lit(0)).alias(x) for x in counts], F.round(F.coalesce("ms", F.lit(0)) / 60000, 6).alias("duration_minutes"))


def search_sessions(conversations: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Sessions whose title holds ``query``, whatever the case; the last updated first."""
    t = conversations.where(F.lower("name").contains(query.lower()))
    return t.orderBy(F.desc_nulls_last(F.col("updated_at").try_cast("timestamp")), "uuid").limit(limit)


def projects(a: Archive, archived: bool = True) -> DataFrame:
    """Projects with the number of their conversations; without the archived ones if the table says which they are."""
    n = a.conversations.where(~blank("project_uuid")).groupBy(F.col("project_uuid").alias("uuid")).agg(F.count("*").alias("n_conversations"))
    p = a.projects if archived else a.projects.where(optional(a.projects, "archived_at").isNull())
    return p.join(n, "uuid", "left").select("uuid", "name", F.coalesce("n_conversations", F.lit(0)).alias("n_conversations"))


def conversation_url(c: Column, base: str = "https://example.org") -> Column:
    """Sessions live under /code/, all else under /chat/."""
    return F.when(c.startswith("session_"), F.concat(F.lit(f"{base}/code/"), c)).otherwise(F.concat(F.lit(f"{base}/chat/"), c))


def random_sample(a: Archive, n: int = 100, seed: str = "7") -> DataFrame:
    """n messages at random, the same for the same seed: the first by a hash of uuid and seed."""
    chosen = a.raw("messages").where("uuid is not null").select("uuid").distinct().orderBy(F.md5(F.concat("uuid", F.lit(seed))), "uuid").limit(n)
    # the versions of the chosen ones only
    v = a.message_versions().join(chosen, "uuid", "left_semi")
    return a.last_versions(v).select("uuid", "conversation_uuid", "sender", "text")


def without_profile(conversations: DataFrame, profiles: DataFrame) -> DataFrame:
    """The work-list of an incremental run: conversations that have no profile yet."""
    return conversations.join(profiles.select(F.col("conversation_uuid").alias("uuid")), "uuid", "left_anti")


def optional(df: DataFrame, column: str, kind: str = "string") -> Column:
    """A column that older tables may lack, NULL where they do."""
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)
