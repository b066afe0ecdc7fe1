"""Chat formatting: turns of typed content parts become one text with marks, a loss mask and attachment references.

A turn is ``<s>[INST]role[/INST]content</s>``. A visitor goes over the parts of a turn in order: text is escaped and
kept, an image, audio or document part becomes its placeholder, and its reference, place and expanded number of tokens
are recorded. A control string inside a text gets one more backslash after its first character than it has there, and
reading takes one away, so every text comes back as it was and only real marks read as marks.

Defined results: a null text or role is empty; turns are ordered by turn, null first, then role and parts; a part of
unknown type is an attachment with its type as placeholder text; repeated rows are repeated turns; no rows, no
conversations. A conversation is one text, so its turns are gathered in one row; conversations are dealt by id.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own

OPEN, NAMED, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: The strings with a meaning in the output, and the placeholders of the part types.
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", *PLACEHOLDERS.values())
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def _each(change):
    return lambda c: reduce(lambda x, control: change(x, control[0], control[1:]), CONTROLS, c)


#: Applied to a text column; unescape(escape(x)) is x for every x, and escape(x) holds no control string.
escape = _each(lambda c, a, rest: F.regexp_replace(c, f"{re.escape(a)}(\\\\*){re.escape(rest)}", f"{a}\\\\$1{rest}"))
unescape = _each(lambda c, a, rest: F.regexp_replace(c, f"{re.escape(a)}\\\\(\\\\*){re.escape(rest)}", f"{a}$1{rest}"))


def text_parts(text: Column) -> Column:
    """A plain text as the only part of a turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def visit(parts: Column) -> Column:
    """The parts' text in the output: escaped, or a placeholder."""

    def one(p: Column) -> Column:
        kind = F.coalesce(p["kind"], F.lit("text"))
        mark = reduce(lambda c, kv: F.when(kind == kv[0], kv[1]).otherwise(c), PLACEHOLDERS.items(), F.concat(F.lit("[IMAGE]"), escape(kind)))
        return F.when(kind == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)

    return F.array_join(F.transform(parts, one), "")


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points), attachments, expanded_tokens.

    turns has one row a turn; parts is of type PARTS. loss_spans cover the contents of the turns of loss_roles.
    """
    t = own(turns, conv_id, turn, role, parts).toDF("conv_id", "turn", "role", "parts")
    t = t.withColumn("parts", F.coalesce("parts", F.array().cast(PARTS)))
    t = t.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col("parts")).alias("content"), F.filter("parts", lambda p: p["kind"] != "text").alias("others"))
    t = t.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(NAMED)))
    t = t.withColumn("length", F.length("head") + F.length("content") + len(CLOSE))
    got = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "head", "length", "others"))).alias("t"))
    got = got.withColumn("formatted", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["content"], F.lit(CLOSE))), ""))
    # running ends of the turns, then the spans of those under the loss
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(a: Column, x: Column) -> Column:
        span = F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["content"]).alias("length"))
        spans = F.when(x["role"].isin(*loss_roles), F.array_append(a["spans"], span)).otherwise(a["spans"])
        return F.struct((a["at"] + x["length"]).alias("at"), spans.alias("spans"))

    got = got.withColumn("loss_spans", F.aggregate("t", step, add, lambda a: a["spans"]))
    attached = F.flatten(F.transform("t", lambda x, i: F.transform(x["others"], lambda p: F.struct(i.alias("turn_index"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["units"].alias("tokens")))))
    got = got.withColumn("attachments", attached)
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0)))
    return got.select("conv_id", "formatted", "loss_spans", "attachments", tokens.alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as structs of role and text, unescaped; placeholders stay as they are."""

    def one(x: Column) -> Column:
        body = F.substring(x, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(body, NAMED, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + len(NAMED) + 1)).alias("text"))

    pieces = F.split(formatted, re.escape(CLOSE), -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = format_chats(told.unionByName(more).withColumn("parts", text_parts(F.col("text"))))
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(c: str) -> str:
    return reduce(lambda x, k: f"regexp_replace({x}, '{re.escape(k[0])}(\\\\*){re.escape(k[1:])}', '{k[0]}\\\\\\1{k[1:]}', 'g')", CONTROLS, c)


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(OPEN) + len(NAMED) + len(CLOSE)}) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""
