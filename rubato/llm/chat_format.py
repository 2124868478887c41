"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it, of
which only that reply is trainable.  A turn is written as::

    ### role: text</turn>

Inside roles and texts a backslash is doubled, ``### `` becomes ``#\\## `` and
``</turn>`` becomes ``<\\/turn>``; in roles ``: `` becomes ``:\\ `` as well.  So a
control string never occurs inside a turn, a plain split finds the turns, and
dropping each escaping backslash gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table

HEAD, COLON, END = "### ", ": ", "</turn>\n"
TRAINABLE_ROLE = "assistant"
#: The conversation that the query adds, to show that control strings survive.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), (HEAD, "#\\## "), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(COLON), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, target, formatted, loss_start, loss_chars.

    ``target`` is the position (from 0) of the example's last turn.  The
    trainable span is ``loss_chars`` code points of ``formatted`` from
    ``loss_start`` (from 0).  A conversation that does not end with an
    assistant turn has a last example of all its turns in which nothing is
    trainable (``loss_chars`` null), so that no turn is lost.

    Turns go by ``turn``, null first, equal ones by role and text; repeated
    rows are turns of their own.  A null role or text counts as empty, a null
    conv_id is a conversation like any other, other columns are ignored, and an
    empty table has no examples.  A conversation has to fit in one row, as its
    last example holds all of it; its examples are made one at a time.
    """
    empty = F.lit("")
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t")
    )
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(COLON), escape(t["text"]), F.lit(END)))
    last = F.size("turns") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == TRAINABLE_ROLE) | (i == last))
    rows = talks.select("conv_id", "turns", written.alias("written"), targets.alias("targets")).select(
        "conv_id", "turns", "written", F.explode("targets").alias("target")
    )
    reply = F.get("turns", F.col("target"))
    loss_chars = F.when(reply["role"] == TRAINABLE_ROLE, F.length(escape(reply["text"])))
    return rows.select(
        "conv_id", "target", F.array_join(F.slice("written", F.lit(1), F.col("target") + 1), "").alias("formatted"), loss_chars.alias("loss_chars")
    ).select("conv_id", "target", "formatted", (F.length("formatted") - F.col("loss_chars") - len(END)).alias("loss_start"), "loss_chars")


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted text."""
    parts = F.split(formatted, END)

    def turn(part: Column) -> Column:
        at = F.instr(part, COLON)
        return F.struct(
            unescape(F.substring(part, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(part, at + len(COLON), F.length(part))).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns, trainable text and sizes."""
    trained = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))
    read = examples.select(
        "conv_id", "target", F.length("formatted").cast("long").alias("chars"), F.when(F.col("loss_chars").isNotNull(), unescape(trained)).alias("reply"),
        "formatted",
    )
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("target", "reply")))).alias("replies"),
        F.sum("chars").alias("formatted_chars"),
    )
    told = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = whole.select("conv_id", "formatted_chars", read_turns(F.col("formatted")).alias("turns"), F.array_join("replies.reply", "").alias("loss"))
    return loss.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", told), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """All conversations and one whose texts hold the template's control strings."""
    rows = [(PROBE_ID, i, role, PROBE_TEXT) for i, role in enumerate(("user", TRAINABLE_ROLE))]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "chat")
    examples = prefix_target_examples(with_probe(table(spark, sf_dir, "conversations")))
    examples.write.option("compression", "zstd").parquet(path)
    return conversation_digests(spark.read.schema(examples.schema).parquet(path))


def _oracle() -> str:
    esc = r"replace(replace(replace({}, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>')"
    return rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE_TEXT}'), (-7, 1, 'assistant', '{PROBE_TEXT}')
), turns AS (
  SELECT *, length({esc.format("text")}) + length(replace({esc.format("role")}, ': ', ':\ ')) + {len(HEAD + COLON + END)} AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM said
), upto AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(prefix) FILTER (role = 'assistant' OR pos = n))::BIGINT AS formatted_chars
FROM upto GROUP BY conv_id
"""


ORACLE_SQL = {"op2_chat_format": _oracle()}
