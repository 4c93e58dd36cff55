"""Chat formatting: layouts are recognised by a hash of their nested field paths.

A record's schema (of the parsed JSON, scalar types left out) is hashed; the hash selects a
declarative mapping, which turns prompt, instruction and message layouts into canonical
turns. A template then marks turns, escapes control strings in texts, and gives the spans
that count for the loss. All of it is SQL expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The strings that have a meaning in formatted text (fixed values).
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[SEP]"]
_CONTROL_RE = r"(<)(?=/?s>)|(<)(?=</?SYS>>)|(\[)(?=(?:/?INST|/?ROLE|SEP)\])"

#: Names that message layouts give the roles; rows by turn keep their own.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: A JSON field's name with its colon, or the quotes of a string value; matched without going
#: back or calling deeper, so that texts may be long.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NAME_OR_VALUE = rf'(?s)({_STRING}\s*+:)|(")[^"\\]*+(?:\\.[^"\\]*+)*+(")'
#: Records and texts may be as long as Spark's strings.
_LONG = {"maxStringLen": str((1 << 31) - 1)}


@dataclass(frozen=True)
class Layout:
    """How turns lie in a record: a list of turns under the field `turns` (then role and text
    name its fields, order the one to sort by), or one field per turn in `fields`, as (field, role)."""

    name: str
    example: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    fields: tuple[tuple[str, str], ...] = ()


LAYOUTS = [
    Layout("turn_rows", '{"turns":[{"role":"x","text":"x","turn":1}]}', "turns", "role", "text", "turn"),
    Layout("messages", '{"messages":[{"content":"x","role":"x"}]}', "messages", "role", "content"),
    Layout("conversations", '{"conversations":[{"from":"x","value":"x"}]}', "conversations", "from", "value"),
    Layout("prompt_completion", '{"completion":"x","prompt":"x"}', fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("prompt_response", '{"prompt":"x","response":"x"}', fields=(("prompt", "user"), ("response", "assistant"))),
    Layout("instruction", '{"instruction":"x","output":"x"}', fields=(("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_input", '{"input":"x","instruction":"x","output":"x"}', fields=(("instruction", "system"), ("input", "user"), ("output", "assistant"))),
    Layout("question_answer", '{"answer":"x","question":"x"}', fields=(("question", "user"), ("answer", "assistant"))),
]


def field_paths(record: Column) -> Column:
    """The nested field names of a JSON record in sorted order, without scalar types.

    Spark's schema of a variant lists an object's fields by name; elements of a list merge
    into one, so a list's length and a scalar's type or a null don't change it. String values
    are emptied first: a variant holds 16 MB at most, a record may hold more.
    """
    schema = F.schema_of_variant(F.try_parse_json(F.regexp_replace(record, _NAME_OR_VALUE, "$1$2$3")))
    return F.regexp_replace(schema, r": (?:VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP(?:_NTZ)?|BINARY|VARIANT)(?=[,>])", ": x")


def fingerprint(record: Column) -> Column:
    return F.substring(F.sha2(field_paths(record), 256), 1, 16)


def layout_table(spark, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """schema_id, layout: as many rows as layouts were declared."""
    rows = F.inline(F.array(*[F.struct(F.lit(x.name).alias("layout"), F.lit(x.example).alias("example")) for x in layouts]))
    return spark.range(1).select(rows).select(fingerprint(F.col("example")).alias("schema_id"), "layout")


def canonical_turns(records: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """records has rec_id and record (JSON). Adds schema_id, layout and turns, an array of
    (role, text), null where no layout fits or the record is no JSON. A missing or null text
    is empty, a missing or null role is ''; a field layout leaves out turns whose field is null.
    A record of a known layout that can't be read in full is an error, not an empty one."""
    table = layout_table(records.sparkSession, layouts)
    # rows of the table are bounded by the declared layouts
    out = records.withColumn("schema_id", fingerprint(F.col("record"))).join(F.broadcast(table), "schema_id", "left")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in layouts:
        found = _listed_turns(x) if x.turns else _field_turns(x)
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("record without turns: "), F.coalesce(F.col("rec_id").cast("string"), F.lit("null")))))
        turns = F.when(F.col("layout") == x.name, found).otherwise(turns)
    return out.withColumn("turns", turns)


def _listed_turns(x: Layout) -> Column:
    fields = ", ".join([f"`{x.role}` string, `{x.text}` string"] + ([f"`{x.order}` long"] if x.order else []))
    listed = F.from_json("record", f"`{x.turns}` array<struct<{fields.replace('` ', '`:')}>>", _LONG)[x.turns]
    if x.order:
        ordered = lambda t: F.struct(t[x.order].alias("o"), F.coalesce(t[x.role], F.lit("")).alias("role"), F.coalesce(t[x.text], F.lit("")).alias("text"))
        return F.transform(F.array_sort(F.transform(listed, ordered)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.transform(listed, lambda t: F.struct(_role(t[x.role]).alias("role"), F.coalesce(t[x.text], F.lit("")).alias("text")))


def _field_turns(x: Layout) -> Column:
    parsed = F.from_json("record", ", ".join(f"`{field}` string" for field, _ in x.fields), _LONG)
    each = [F.struct(F.lit(role).alias("role"), parsed[field].alias("text")) for field, role in x.fields]
    return F.filter(F.array(*each), lambda t: t["text"].isNotNull())


def _role(name: Column) -> Column:
    pairs = [F.lit(x) for pair in ROLE_NAMES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[name], name, F.lit(""))


def escaped(text: Column) -> Column:
    r"""Doubles every \ and breaks every control string by a \ after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_RE, r"$1$2$3\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _before(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE] "), escaped(role), F.lit(" [SEP] "))
    return F.when(role == "user", "[INST] ").when(role == "assistant", "<s> ").when(role == "system", "<<SYS>> ").otherwise(other)


def _after(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", " </s>").when(role == "system", " <</SYS>>").otherwise(" [/ROLE]")


def format_turns(records: DataFrame) -> DataFrame:
    """rec_id, formatted, loss_spans: the text of all turns and where, in code points from 0,
    the assistant's texts (escaped) stand. Records without turns are formatted as ''.

    One record's turns make one text, so they meet in one task; a record's length is the bound.
    """
    turn = records.select("rec_id", F.posexplode_outer("turns").alias("pos", "turn"))
    role, text = F.col("turn.role"), F.coalesce(F.col("turn.text"), F.lit(""))
    parts = turn.select("rec_id", "pos", role.alias("role"), _before(role).alias("before"), escaped(text).alias("body"), _after(role).alias("after"))
    piece = F.concat("before", "body", "after")
    order = Window.partitionBy("rec_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum(F.length(piece)).over(order), F.lit(0)) + F.length("before"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    rows = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"), span.alias("span"))))
    whole = placed.groupBy("rec_id").agg(rows.alias("rows"))
    return whole.select(
        "rec_id",
        F.coalesce(F.array_join(F.transform("rows", lambda r: F.coalesce(r["piece"], F.lit(""))), ""), F.lit("")).alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


_TURN_RE = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE\] .*? \[/ROLE\]"


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text), unescaped."""

    def turn(piece: Column) -> Column:
        role = (
            F.when(piece.startswith("[INST]"), "user").when(piece.startswith("<s>"), "assistant").when(piece.startswith("<<SYS>>"), "system")
            .otherwise(unescaped(F.regexp_extract(piece, r"(?s)^\[ROLE\] (.*?) \[SEP\] ", 1)))
        )
        body = F.regexp_extract(piece, r"(?s)^(?:\[INST\] |<s> |<<SYS>> |\[ROLE\] .*? \[SEP\] )(.*) (?:\[/INST\]|</s>|<</SYS>>|\[/ROLE\])$", 1)
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN_RE), F.lit(0)), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text rows as one JSON record per conversation (rec_id, record).

    Null roles and texts are kept as empty strings, so every such record has one layout.
    Turns sort by turn (null first), then role, then text; repeated rows are repeated turns.
    """
    turn = F.struct(F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"))
    return rows.groupBy(F.col("conv_id").alias("rec_id")).agg(F.to_json(F.struct(F.collect_list(turn).alias("turns"))).alias("record"))
