"""Chat formatting by a grammar round trip.

Conversations are rendered with a template of control strings, read back by a deterministic parser and compared with their source;
where the two differ, the texts are escaped and the conversation is rendered and read again, until both are identical.
Everything is DataFrame functions.

Grammar: a conversation is its turns, one after the other, each one of
    [SYS] text [/SYS]     [INST] text [/INST]     <s> text </s>     [ROLE] name [SAYS] text [/ROLE]
for the roles system, user, assistant and any other. A control string anywhere else is a parse error. The escape puts one backslash
more behind a control string's first character (and one more where backslashes stand there already), so it is reversible:
"[INST]" becomes "[\\INST]", "[\\INST]" becomes "[\\\\INST]".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

REST = r"(/?(?:SYS|INST|ROLE)\]|SAYS\]|/?s>)"
CONFLICT = r"([<\[])(\\*)" + REST
ESCAPED = r"([<\[])\\(\\*)" + REST
CONTROL = r"[<\[]" + REST
TURN = r"(?s)\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE\] .*? \[SAYS\] .*? \[/ROLE\]"
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER, SAYS, OTHER_END = "[ROLE] ", " [SAYS] ", " [/ROLE]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONFLICT, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _render(turns: Column, safe) -> Column:
    def one(t: Column) -> Column:
        out = F.concat(F.lit(OTHER), safe(t["role"]), F.lit(SAYS), safe(t["text"]), F.lit(OTHER_END))
        for role, (start, end) in MARKS.items():
            out = F.when(t["role"] == role, F.concat(F.lit(start), safe(t["text"]), F.lit(end))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def _inner(t: Column, start: str, end: str) -> Column:
    return t.substr(F.lit(len(start) + 1), F.length(t) - len(start) - len(end))


def _parse_turn(t: Column) -> Column:
    inner = _inner(t, OTHER, OTHER_END)
    name = F.substring_index(inner, SAYS, 1)
    said = inner.substr(F.length(name) + len(SAYS) + 1, F.length(inner))
    out = F.struct(unescape(name).alias("role"), unescape(said).alias("text"))
    for role, (start, end) in MARKS.items():
        out = F.when(t.startswith(start), F.struct(F.lit(role).alias("role"), unescape(_inner(t, start, end)).alias("text"))).otherwise(out)
    return out


def _read_back(df: DataFrame, rendered: str, tag: str) -> DataFrame:
    """Adds ``{tag}_parts`` (the turns' strings) and ``{tag}_turns`` (what they say; null when the string isn't in the grammar)."""
    df = df.withColumn(f"{tag}_parts", F.regexp_extract_all(rendered, F.lit(TURN), 0))
    parts = F.col(f"{tag}_parts")
    controls = F.size(parts) * 2 + F.size(F.filter(parts, lambda t: t.startswith(OTHER)))
    legal = (F.array_join(parts, "") == F.col(rendered)) & (F.regexp_count(rendered, F.lit(CONTROL)) == controls)
    return df.withColumn(f"{tag}_turns", F.when(legal, F.transform(parts, _parse_turn)))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> a row for each conversation.

    Returns conv_id, turns (read back from ``formatted``), formatted, escaped (whether the raw form failed its round trip),
    loss_spans (start, end: code points of ``formatted`` that hold assistants' texts, end exclusive).

    Rows go by turn, ties by role and text. Null role or text counts as empty, null turns come first, a null conv_id is one
    conversation, repeated rows are repeated turns, an empty table gives no rows; other columns are ignored. A conversation is one
    record: its turns meet in one row, as a training example must.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    said = F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    df = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("sorted")).select("conv_id", said.alias("source"))
    df = _read_back(df.withColumn("raw", _render(F.col("source"), lambda x: x)), "raw", "raw")
    same = F.coalesce(F.col("raw_turns") == F.col("source"), F.lit(False))
    df = df.withColumn("escaped", ~same).withColumn("formatted", F.when(F.col("escaped"), _render(F.col("source"), escape)).otherwise(F.col("raw")))
    df = _read_back(df.drop("raw", "raw_parts", "raw_turns"), "formatted", "final")
    whole = F.coalesce(F.col("final_turns") == F.col("source"), F.lit(False))
    spans = F.aggregate(
        "final_parts",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t)).alias("at"),
            F.when(
                t.startswith(MARKS["assistant"][0]),
                F.array_append(acc["spans"], F.struct((acc["at"] + len(MARKS["assistant"][0])).alias("start"), (acc["at"] + F.length(t) - len(MARKS["assistant"][1])).alias("end"))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    turns = F.when(whole, F.col("final_turns")).otherwise(F.raise_error(F.concat(F.lit("no round trip in conversation "), F.col("conv_id"))))
    return df.select("conv_id", turns.alias("turns"), "formatted", "escaped", spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
