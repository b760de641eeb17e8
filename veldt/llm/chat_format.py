"""Chat formatting with a grammar round trip, in DataFrame operations only.

Grammar:  chat  = { turn }
          turn  = "<s>" role "\\n" body "</s>"
          body  = text                          (assistant)
                | "[INST] " text " [/INST]"     (other roles)

A turn is rendered with its text as it is, parsed back and compared; where the result
differs, or a marker would show inside, the text is escaped and parsed again. Escaping
puts one backslash after the opening character of each marker, and of each marker that
is escaped already; reading takes one away. So escaping is reversible at any depth and
texts without markers stay as they are. Roles are written with % < [ and line ends as
%XX. Turns are numbered and laid out by one window over a conversation, then joined by
one aggregate on the same key: one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings, as the tail after their opening character.
TAILS = r"(/?(?:s>|INST\]))"
PLAIN = rf"([<\[])(\\*){TAILS}"
ESCAPED = rf"([<\[])\\(\\*){TAILS}"
ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    for raw, code in ROLE_CODES:
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def _role_in(role: Column) -> Column:
    for raw, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>"), _role_out(role), F.lit("\n"), F.when(role == "assistant", text).otherwise(F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))), F.lit("</s>"))


def _parsed(part: Column) -> Column:
    """(role, text) of one turn without its closing mark; null where it isn't one."""
    cut = F.instr(part, "\n")
    role = _role_in(F.substring(part, F.lit(4), cut - 4))
    body = F.substring(part, cut + 1, F.length(part))
    wrapped = role != "assistant"
    text = F.when(wrapped, F.substring(body, F.lit(8), F.length(body) - 15)).otherwise(body)
    sound = part.startswith("<s>") & (cut > 0) & (~wrapped | (body.startswith("[INST] ") & body.endswith(" [/INST]") & (F.length(body) >= 15))) & ~F.regexp_like(text, F.lit(r"<s>|</s>|\[INST\]|\[/INST\]"))
    return F.when(sound, F.struct(role.alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted chat; a part that breaks the grammar is null."""
    parts = F.split(formatted, "</s>")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), _parsed)


def _spans_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def format_chats(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """By conversation: formatted, loss_spans (half-open, in code points of formatted), turns (read back), n_turns, n_escaped, identical.

    Turns are ordered by turn, then role and text, nulls first; repeated rows are turns of
    their own. A null text or role is empty. Rows with a null conversation form one, whose
    id is null. The loss mask covers assistant texts. `identical` compares what was read
    back with the source; it is false only if the grammar were broken. Other columns are
    dropped. A conversation is one row in the end, so its length bounds one task's memory.
    """
    rows = turns.select(F.col(conv_column).alias("conv_id"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    raw = _turn(F.col("role"), F.col("text"))
    rows = rows.withColumn("_raw", raw)
    back = _parsed(F.substring(F.col("_raw"), F.lit(1), F.length("_raw") - 4))
    same = F.coalesce((back["role"] == F.col("role")) & (back["text"] == F.col("text")), F.lit(False))
    rows = rows.withColumn("_same", same).withColumn("part", F.when(F.col("_same"), F.col("_raw")).otherwise(_turn(F.col("role"), escape(F.col("text")))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"place": F.row_number().over(order), "end": F.sum(F.length("part").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("end") - F.length("part") + 4 + F.length(_role_out(F.col("role")))
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (F.col("end") - 4).alias("end")))
    held = F.sort_array(F.collect_list(F.struct("place", "part", "role", "text", span.alias("span"), F.col("_same").alias("same"))))
    chats = rows.groupBy("conv_id").agg(held.alias("held"))
    formatted = F.array_join(F.transform("held", lambda t: t["part"]), "")
    spans = F.filter(F.transform("held", lambda t: t["span"]), lambda s: s.isNotNull())
    chats = chats.select("conv_id", "held", formatted.alias("formatted"), spans.alias("loss_spans"))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("held", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return chats.select(
        "conv_id", "formatted", "loss_spans", "turns", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("held", lambda t: ~t["same"])).cast("long").alias("n_escaped"), (F.col("turns") == source).alias("identical")
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return _spans_text(formatted, spans)
