"""Chat formatting with a grammar round trip, by DataFrame functions only.

The grammar of a rendered conversation::

    conversation = { turn }
    turn         = "<s>" role "[INST] " text " [/INST]" "</s>"        (any other role)
                 | "<s>" role "[RESP] " text " [/RESP]" "</s>"        (assistant: the loss mask)

where neither role nor text holds a control string, a role no ``[`` or ``<``, and the
parser reads ``&lt;``, ``&#91;`` and ``&amp;`` as ``<``, ``[`` and ``&``. What does not
follow the grammar parses to a turn without text, so it differs from its source.

A conversation is rendered as it is and parsed back. Where the parsed turns differ from
the source, each turn is tried alone, the content of those that differ is escaped, and the
conversation is rendered and parsed again; if it still differs, all of its turns are
escaped. ``rounds`` says how many renderings it took, ``round_trip`` whether the last one
gave the source back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"</?s>|\[/?(?:INST|RESP)\]"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&#91;", "["))


def escape(s: Column) -> Column:
    """``&``, ``<`` and ``[`` by their entities."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), ENTITIES, s)


def unescape(s: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), reversed(ENTITIES), s)


def render_turn(turn: Column, escaped: Column) -> Column:
    tag = F.when(turn["role"] == "assistant", F.lit("RESP")).otherwise(F.lit("INST"))
    role, text = (F.when(escaped, escape(turn[c])).otherwise(turn[c]) for c in ("role", "text"))
    return F.concat(F.lit("<s>"), role, F.lit("["), tag, F.lit("] "), text, F.lit(" [/"), tag, F.lit("]</s>"))


def parse(formatted: Column) -> Column:
    """Turns (role, text, loss) of a rendered conversation; text and loss are null where it breaks the grammar."""
    raw = F.filter(F.split(formatted, "</s>"), lambda t: t != "")

    def turn(t: Column) -> Column:
        body = F.substring_index(t, "[", 1)  # <s>role
        tag = F.substr(t, F.length(body) + 2, F.lit(4))
        start = F.length(body) + F.lit(8)
        text = F.substr(t, start, F.length(t) - start - F.lit(7))
        role = F.substr(body, F.lit(4))
        good = F.startswith(t, F.lit("<s>")) & F.endswith(t, F.concat(F.lit(" [/"), tag, F.lit("]"))) & tag.isin("INST", "RESP") & ~F.contains(role, F.lit("<")) & ~text.rlike(CONTROL)
        return F.struct(unescape(role).alias("role"), F.when(good, unescape(text)).alias("text"), F.when(good, tag == "RESP").alias("loss"))

    return F.transform(raw, turn)


def _told(turns: Column) -> Column:
    """What is compared: role and text of each turn."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _once(x: Column) -> Column:
    """Evaluated once a row; a plain projection would be put into each place that refers to it."""
    return F.explode(F.array(x))


def _rendered(escaped) -> Column:
    """Formatted text and parsed turns of ``source``; ``escaped`` says by turn whether to escape it."""
    return F.array_join(F.transform("source", lambda t: render_turn(t, escaped(t))), "")


def format_chats(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: id, ``formatted``, ``turns`` (parsed back), ``round_trip``, ``rounds``.

    ``rows``: (conv, turn, role, text), other columns are ignored. Null roles and texts
    are empty; turns sort by number (null first), then role and text, so ties and
    repeated rows have one order; a null id is one conversation; a conversation is one
    string, so its turns meet in one row. An empty table gives no rows.
    """
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    out = rows.groupBy(F.col(conv).alias("_conv")).agg(turns.alias("source"))
    same = _told(F.col("turns")).eqNullSafe(_told(F.col("source")))
    alone = lambda t: ~_told(parse(render_turn(t, F.lit(False)))).eqNullSafe(F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    # as it is; with the turns escaped that do not come back; with all turns escaped
    tries = [lambda t: F.lit(False), alone, lambda t: F.lit(True)]
    out = out.withColumn("formatted", _once(_rendered(tries[0]))).withColumn("turns", _once(parse(F.col("formatted")))).withColumn("rounds", F.lit(1))
    for k, escaped in enumerate(tries[1:], 2):
        out = out.withColumn("_ok", _once(same))
        out = out.withColumn("formatted", _once(F.when(F.col("_ok"), F.col("formatted")).otherwise(_rendered(escaped))))
        out = out.withColumn("turns", _once(F.when(F.col("_ok"), F.col("turns")).otherwise(parse(F.col("formatted"))))).withColumn("rounds", F.when(F.col("_ok"), F.col("rounds")).otherwise(F.lit(k)))
    return out.select(F.col("_conv").alias(conv), "formatted", "turns", same.alias("round_trip"), "rounds")


def chat_digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what was read back from the formatted conversations."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return formatted.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


#: The same digests from the source rows, for an engine that shares nothing with the above.
DIGEST_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows
), e AS (SELECT *, regexp_matches(text, '</?s>|\[/?(INST|RESP)\]|&(lt|#91|amp);') OR regexp_matches(role, '[<\[]|&(lt|#91|amp);') AS conflict FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN conflict THEN length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) ELSE length(role || text) END + 22) AS BIGINT) AS formatted_chars,
  true AS round_trip
FROM e GROUP BY conv_id
"""
