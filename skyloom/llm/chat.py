r"""Chat formatting from event logs, with DataFrame functions only.

A log is a table (conv_id, part, message, seq, kind, role, text) of what happened to the messages of conversations:

* ``open`` begins a message with its role and the beginning of its text, ``delta`` adds streamed text to it;
* ``edit`` puts another text in place of a message's;
* ``regenerate`` takes a message's text away, for the deltas that follow, and with it all later messages that had been
  opened before: the conversation goes on from there.

``seq`` (any type with an order) orders the events of a conversation, (part, message) the messages. Parts are runs of
messages of a bounded length, so that a conversation with very many messages is folded in many tasks: an event meets only
those of its own message, messages meet those of their own part, and what parts hand on to each other is one row a part.
An event that was delivered twice counts once.

Final messages are rendered as pieces, one a row: the pieces of a conversation in order are its text, and ``start`` says
where in it each begins. ``loss_start`` and ``loss_length`` are the span of an assistant's (escaped) text, which is what a
model is trained on. In texts and roles a backslash is doubled and each control string gets one after its first
character, so a piece holds no control string but its own three and its content comes back as it was.

Defined cases: null roles and texts count as empty ones; null conv_ids are one conversation; a null part comes first;
messages without an ``open`` have an empty role; rows of one turn are in the order of role and text, and repeated rows are
turns of their own (``log_of``); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.folders import shared_dir
from .storage import saved

#: Control strings of public chat templates.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_sep|>", "<|im_end|>")


@dataclass(frozen=True)
class Template:
    """A turn is begin + role + between + text + end. Each marker holds its first character only there."""

    begin: str = "<|im_start|>"
    between: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    trained: str = "assistant"
    controls: tuple[str, ...] = CONTROLS

    def escaped(self, c: Column) -> Column:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        for s in dict.fromkeys((self.begin, self.between, self.end, *self.controls)):
            c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
        return c

    @staticmethod
    def unescaped(c: Column) -> Column:
        return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def log_of(rows: DataFrame, delta_chars: int = 200, part_turns: int = 256) -> DataFrame:
    """The log that leads to a table (conv_id, turn, role, text): texts streamed in deltas, by a checksum some with a draft.

    A third of the assistant's messages are streamed wrongly first, with an answer to the draft, and regenerated; a quarter
    of the others are opened with a draft and edited.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("part", F.floor(F.col("turn") / part_turns))
    order = W.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    event = lambda kind, t, later=0: F.struct(F.lit(later).alias("later"), F.lit(kind).alias("kind"), t.alias("text"))
    streamed = lambda t: F.transform(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0)), lambda d: event("delta", d))
    nothing, draft = F.lit(""), F.reverse(F.substring("text", 1, 2 * delta_chars))
    draw = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text")).cast("binary"))
    again = (F.col("role") == "assistant") & (draw % 3 == 0)
    edited = (F.col("role") != "assistant") & (draw % 4 == 0)
    anew = F.concat(F.array(event("open", nothing)), streamed(draft), F.array(event("open", draft, 1), event("regenerate", nothing)), streamed(F.col("text")))
    events = F.when(again, anew).when(edited, F.array(event("open", draft), event("edit", F.col("text")))).otherwise(F.concat(F.array(event("open", nothing)), streamed(F.col("text"))))
    rows = rows.withColumn("nth", F.row_number().over(order).cast("long"))
    out = rows.select("conv_id", "part", "nth", "role", F.posexplode(events).alias("k", "e"))
    return out.select(
        "conv_id", "part", (2 * F.col("nth") + F.col("e.later")).alias("message"), F.struct("part", "nth", "k").alias("seq"), F.col("e.kind").alias("kind"),
        F.when(F.col("e.kind") == "open", F.when(F.col("e.later") == 0, F.col("role")).otherwise("user")).alias("role"), F.col("e.text").alias("text"),
    )


def of_parts_before(df: DataFrame, gathered: Column, over: str) -> DataFrame:
    """(p_conv, p_part, before): `gathered` over each part's rows, and of these the function named `over` over the conversation's parts before."""
    parts = df.groupBy("conv_id", "part").agg(gathered.alias("g"))
    ahead = W.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(F.col("conv_id").alias("p_conv"), F.col("part").alias("p_part"), getattr(F, over)("g").over(ahead).alias("before"))


def with_part(df: DataFrame, parts: DataFrame) -> DataFrame:
    same = F.col("conv_id").eqNullSafe(F.col("p_conv")) & F.col("part").eqNullSafe(F.col("p_part"))
    return df.join(parts, same).drop("p_conv", "p_part")


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, part, message, role, text): the final messages of each conversation."""
    text = lambda c: F.coalesce(c, F.lit(""))
    events = F.array_distinct(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))))
    found = log.groupBy("conv_id", "part", "message").agg(events.alias("e"))
    kept = found.select("conv_id", "part", "message", "e", F.filter("e", lambda x: x["kind"].isin("open", "edit", "regenerate")).alias("resets"))
    last = F.element_at("resets", -1)["seq"]
    final = F.filter("e", lambda x: last.isNull() | (x["seq"] >= last))
    opens = F.filter("e", lambda x: x["kind"] == "open")
    messages = kept.select(
        "conv_id", "part", "message", text(F.try_element_at(opens, F.lit(-1))["role"]).alias("role"), F.array_join(F.transform(final, lambda x: text(x["text"])), "").alias("text"),
        F.element_at("e", 1)["seq"].alias("opened"), F.array_max(F.transform(F.filter("e", lambda x: x["kind"] == "regenerate"), lambda x: x["seq"])).alias("rewound"),
    )
    messages = saved(messages, "messages")
    ahead = W.partitionBy("conv_id", "part").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    messages = with_part(messages.withColumn("within", F.max("rewound").over(ahead)), of_parts_before(messages, F.max("rewound"), "max"))
    left = lambda c: F.coalesce(F.col(c) > F.col("opened"), F.lit(False))
    return messages.where(~left("within") & ~left("before")).select("conv_id", "part", "message", "role", "text")


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, part, message, piece, start, loss_start, loss_length) of each message; places count code points of the conversation's text."""
    role, text = template.escaped(F.col("role")), template.escaped(F.col("text"))
    head = F.concat(F.lit(template.begin), role, F.lit(template.between))
    out = messages.select("conv_id", "part", "message", (F.col("role") == template.trained).alias("trained"), head.alias("head"), text.alias("body"))
    out = out.select("*", F.concat("head", "body", F.lit(template.end)).alias("piece")).withColumn("n", F.char_length("piece").cast("long"))
    ahead = W.partitionBy("conv_id", "part").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    out = with_part(out.withColumn("within", F.sum("n").over(ahead)), of_parts_before(out, F.sum("n"), "sum"))
    start = F.coalesce("within", F.lit(0)) + F.coalesce("before", F.lit(0))
    spans = (F.when(F.col("trained"), start + F.char_length("head")).alias("loss_start"), F.when(F.col("trained"), F.char_length("body")).cast("long").alias("loss_length"))
    return out.select("conv_id", "part", "message", "piece", start.alias("start"), *spans)


def write_chat(messages: DataFrame, folder: str, template: Template = Template()) -> None:
    render(saved(messages, "final"), template).write.parquet(folder)


def read_chat(spark: SparkSession, folder: str, template: Template = Template()) -> DataFrame:
    """(conv_id, part, message, role, text, loss, n_chars) read out of written pieces: loss is the text under the loss mask, null without one."""
    pieces = spark.read.parquet(folder)
    role = F.substring_index(F.substr("piece", F.lit(len(template.begin) + 1)), template.between, 1)
    pieces = pieces.withColumn("r", role)
    before = F.char_length("r") + len(template.begin) + len(template.between)
    text = F.substr("piece", before + 1, F.char_length("piece") - before - len(template.end))
    loss = F.substr("piece", (F.col("loss_start") - F.col("start") + 1).cast("int"), F.col("loss_length").cast("int"))
    plain = template.unescaped
    return pieces.select("conv_id", "part", "message", plain(F.col("r")).alias("role"), plain(text).alias("text"), plain(loss).alias("loss"), F.char_length("piece").cast("long").alias("n_chars"))


def formatted(pieces: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): a conversation in one row, with its spans (start, length), for those that fit one."""
    every = F.array_sort(F.collect_list(F.struct("start", "piece", "loss_start", "loss_length")))
    out = pieces.groupBy("conv_id").agg(every.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_length"].alias("length")))
    return out.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_mask"))


def chat_digest(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of ``read_chat``. A digest of a conversation needs its text in one row."""
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    part = F.coalesce("part", F.lit(-(1 << 62)))
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part.alias("p"), "message", c.alias("t")))), lambda x: x["t"]), "")
    out = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), whole(line).alias("t"), whole(F.coalesce("loss", F.lit(""))).alias("l"), F.sum("n_chars").alias("formatted_chars")
    )
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("conv_id", "n_turns", digest("t").alias("turns_sha256"), F.char_length("l").cast("long").alias("loss_chars"), digest("l").alias("loss_sha256"), "formatted_chars")


#: The conversation that says control strings.
SAID = "</s>[INST] ok [/INST]"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    folder = f"{shared_dir(spark)}/chat"
    write_chat(fold(log_of(rows.unionByName(own))), folder)
    return chat_digest(read_chat(spark, folder))


def _escaped_sql(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for s in CONTROLS:
        c = f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')"
    return c


#: Turns hashed as they are; the length of what the template makes of them.
OP13_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{SAID}'), (-7, 1, 'assistant', '{SAID}')),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS l,
    sum({sum(map(len, CONTROLS[-3:]))} + length({_escaped_sql("role")}) + length({_escaped_sql("text")}))::BIGINT AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM c
"""
