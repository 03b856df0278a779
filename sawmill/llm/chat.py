"""Chat formatting with typed content parts.

A message is an array of parts.  A visitor (one case per part type) turns each part into text or an
ordered placeholder, with the attachment's reference and the number of tokens the placeholder
expands to.  The template writes ``<|start|>role<|message|>content<|end|>`` per turn; no text can
forge a control string, because a backslash follows every ``<`` and ``[`` of a text (and a backslash
is doubled), which :func:`unescape` takes back.  Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sawmill.llm.common import col

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: type of a part → placeholder name; any other type is text.
PLACEHOLDERS = {"image": "image", "audio": "audio", "document": "document"}
PART = "struct<type:string,text:string,ref:string,units:bigint>"
PARTS = f"array<{PART}>"
#: tokens per unit: a 14-pixel patch of an image, 40 ms of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 1, "audio": 1, "document": 256}


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|(\\)\\", "$1$2")


def text_parts(text: Column) -> Column:
    """A plain text as a message of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def _placeholder(part: Column) -> Column:
    """Placeholder name of a part, null for text."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv]),
                        F.coalesce(part["type"], F.lit("text")))


def visit(parts: Column) -> Column:
    """Content of a message: text escaped, other parts as ``<|image|>`` and so on, in order."""
    return F.concat_ws("", F.transform(F.coalesce(parts, F.array().cast(PARTS)), lambda p: F.coalesce(
        F.concat(F.lit("<|"), _placeholder(p), F.lit("|>")), escape(F.coalesce(p["text"], F.lit(""))))))


def attachments(parts: Column) -> Column:
    """References and expanded token counts of the parts that are no text, in order."""
    per_unit = F.create_map(*[x for k, v in TOKENS_PER_UNIT.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    other = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: _placeholder(p).isNotNull())
    return F.transform(other, lambda p: F.struct(
        p["type"].alias("type"), p["ref"].alias("ref"),
        (F.coalesce(p["units"], F.lit(1)) * F.element_at(per_unit, p["type"])).alias("tokens")))


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                parts_col: str = "parts", *, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_col``, ``formatted``, ``loss_spans``, ``attachments``,
    ``expanded_tokens``.

    ``loss_spans`` holds (start, length) in code points of ``formatted``: the content of each turn of
    ``loss_role``.  ``attachments`` holds the parts that are no text in order; the k-th belongs to
    the k-th placeholder of ``formatted``.

    Turns are ordered by turn (nulls first), then role, then content; repeated rows are repeated
    turns.  A null role is an empty role, a null message an empty one.  Null conversation ids are one
    conversation.  An empty table gives an empty result.  Other columns are not read.
    """
    rows = messages.select(col(conv_col).alias("_c"), col(turn_col).alias("_t"),
                           F.coalesce(col(role_col).cast("string"), F.lit("")).alias("_role"),
                           visit(col(parts_col)).alias("_content"), attachments(col(parts_col)).alias("_att"))
    head = F.concat(F.lit(START), escape(F.col("_role")), F.lit(MESSAGE))
    rows = rows.withColumn("_piece", F.concat(head, F.col("_content"), F.lit(END))).withColumn("_lead", F.length(head))
    order = Window.partitionBy("_c").orderBy("_t", "_role", "_content")
    before = F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_at", before)
    turn = F.struct("_n", "_piece", "_att", F.when(F.col("_role") == loss_role, F.struct(
        (F.col("_at") + F.col("_lead")).alias("start"), F.length("_content").cast("bigint").alias("length"))).alias("_span"))
    turns = rows.groupBy("_c").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    spans = F.filter(F.transform("_turns", lambda x: x["_span"]), lambda x: x.isNotNull())
    att = F.flatten(F.transform("_turns", lambda x: x["_att"]))
    out = turns.select(F.col("_c").alias(conv_col), F.concat_ws("", F.transform("_turns", lambda x: x["_piece"])).alias("formatted"),
                       spans.alias("loss_spans"), att.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """Array of (role, content) read back from a formatted conversation; content is unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.replace(F.substring_index(p, MESSAGE, 1), F.lit(START), F.lit(""))).alias("role"),
        unescape(F.substring_index(p, MESSAGE, -1)).alias("content")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, read from the formatted text by its spans."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\')) AS text_chars,
         length(replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\')) AS role_chars
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(text_chars + role_chars + 27)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
