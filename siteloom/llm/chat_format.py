"""Chat formatting by schema fingerprint, in DataFrame functions only.

Every layout names the nested field paths it needs and how they become turns. The
fingerprint of a layout is the hash of its sorted paths; a table (or a JSON record) has
a layout when the hash of those of its paths that the layout names is the same. The
layout with the most paths wins, then the first. Further fields, whatever their names,
change nothing. Typed tables are matched once by their schema, JSON records row by row; a path through
an array is there when any element has it. JSON records that are no JSON, fit no layout, hold no turn, or hold
a list element that is no message are rejected whole, with the reason; null elements of lists are left out.

Canonical turns are rows (conv_id, turn, role, text); null roles and texts are empty.
A turn is written as ``<s>role\\ntext</s>`` with the role URL-encoded and every control
string inside a text broken by a backslash, one more than it already had, so the text can be
restored exactly. Turns of equal number are ordered by role and text; repeated rows stay.
A null conversation id is one conversation of its own. The loss mask lists the spans of
assistant texts in the formatted string (code points).

A conversation is one string of the output, so its turns meet in one task by need.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

BEGIN, END = "<s>", "</s>"
OPENER = r"([<\[])"
INSIDE = r"(?=/?s>|/?INST\])"
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """``turns``: ("rows", turn, role, text), ("list", path, role, text), or ("fields", (role, field, ...), ...),
    where fields that are null or empty are left out and several of one turn are joined by a blank line."""

    name: str
    paths: tuple[str, ...]
    turns: tuple = field(default=())

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text"), ("rows", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), ("list", "messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"), ("list", "conversations", "from", "value")),
    Layout("instruction with input", ("instruction", "input", "output"),
           ("fields", ("user", "instruction", "input"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), ("fields", ("user", "instruction"), ("assistant", "output"))),
    Layout("prompt and completion", ("prompt", "completion"), ("fields", ("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), ("fields", ("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", ("question", "answer"), ("fields", ("user", "question"), ("assistant", "answer"))),
)

#: Role names of nested layouts that mean a canonical one; rows of turns keep theirs.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256(";".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: DataType, at: str = "") -> list[str]:
    """Every nested field path of a type: ``a.b``, and ``a[].b`` through arrays."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, MapType):
        return field_paths(kind.valueType, f"{at}{{}}")
    return [at]


def layout_of(schema: StructType, layouts=LAYOUTS) -> Layout:
    paths = set(field_paths(schema))
    fit = [x for x in layouts if fingerprint(p for p in x.paths if p in paths) == x.fingerprint]
    if not fit:
        raise ValueError(f"no layout has these fields: {sorted(paths)}")
    return max(fit, key=lambda x: len(x.paths))


def canonical_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(names[role], role, F.lit(""))


def turn_struct(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def renamed(role: str, text: str):
    return lambda message: turn_struct(message[role], message[text])


def field_turns(turns: tuple, get) -> Column:
    """An array of (role, text) from single fields."""
    built = []
    for role, *names in turns:
        texts = [F.when(get(n).cast("string") != "", get(n).cast("string")) for n in names]
        built.append(F.when(F.coalesce(*texts).isNotNull(), turn_struct(F.lit(role), F.concat_ws("\n\n", *texts))))
    return F.filter(F.array(*built), lambda t: t.isNotNull())


def exploded(df: DataFrame, conv_id: Column, turns: Column) -> DataFrame:
    return (df.select(conv_id.alias("conv_id"), F.posexplode(turns).alias("turn", "said"))
            .select("conv_id", F.col("turn").cast("long").alias("turn"), canonical_role(F.col("said.role")).alias("role"),
                    F.coalesce("said.text", F.lit("")).alias("text")))


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """Turns of a typed table, by the layout that its schema's fingerprint selects."""
    layout = layout_of(df.schema, layouts)
    kind, *names = layout.turns
    if kind == "rows":
        turn, role, text = names
        return df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                         F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if kind == "list":
        path, role, text = names
        turns = F.transform(F.filter(F.col(path), lambda m: m.isNotNull()), renamed(role, text))
        return exploded(df, F.col(conv_id), turns)
    return exploded(df, F.col(conv_id), field_turns(tuple(names), F.col))


def json_items(path: str) -> Column:
    """The elements of a JSON list that are not null; null where there is no list."""
    items = F.try_variant_get("parsed", f"$.{path}", "array<variant>")
    return F.filter(items, lambda m: m.isNotNull() & ~F.is_variant_null(m))


def json_field(name: str) -> Column:
    return F.try_variant_get("parsed", f"$.{name}", "string")


def has_field(value: Column, name: str) -> Column:
    """Whether a JSON value is an object with this field, which may hold a null."""
    return F.try_variant_get(value, f"$.{name}", "variant").isNotNull()


def json_layout(layouts=LAYOUTS) -> Column:
    """Name of the layout of the JSON record ``parsed`` (a variant): the hash of the paths it has among those
    of each layout against that layout's fingerprint. Null when none fits."""
    def present(path: str) -> Column:
        outer, inside, inner = path.partition("[].")
        return F.exists(json_items(outer), lambda m: has_field(m, inner)) if inside else has_field(F.col("parsed"), path)

    chosen = F.lit(None).cast("string")
    for layout in sorted(reversed(layouts), key=lambda x: len(x.paths)):
        found = F.concat_ws(";", *[F.when(present(p), F.lit(p)) for p in sorted(layout.paths)])
        chosen = F.when(F.sha2(found, 256) == layout.fingerprint, F.lit(layout.name)).otherwise(chosen)
    return chosen


def canonical_json_turns(df: DataFrame, record: str, conv_id: str = "conv_id", layouts=LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """Turns of JSON records of mixed layouts, and the rejected rows (conv_id, record, reason): every record is
    in one of the two, whole. A record of the layout "turn rows" is the turn of its own number (null: first);
    turns of several records of one conversation are ordered by number, as those of a table are."""
    marked = df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record"),
                       F.try_parse_json(record).alias("parsed")).withColumn("layout", json_layout(layouts))
    turns, foreign = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>"), F.lit(False)
    for layout in layouts:
        kind, *names = layout.turns
        mine = F.col("layout") == layout.name
        if kind == "rows":
            turn, role, text = names
            own = F.array(F.struct(F.try_variant_get("parsed", f"$.{turn}", "bigint").alias("turn"),
                                   json_field(role).alias("role"), json_field(text).alias("text")))
        else:
            if kind == "list":
                path, role, text = names
                said = F.transform(json_items(path), lambda m: turn_struct(  # noqa: B023
                    F.try_variant_get(m, f"$.{role}", "string"), F.try_variant_get(m, f"$.{text}", "string")))  # noqa: B023
                strange = F.exists(json_items(path), lambda m: ~has_field(m, role) & ~has_field(m, text))  # noqa: B023
                foreign = F.when(mine, strange).otherwise(foreign)
            else:
                said = field_turns(tuple(names), json_field)
            own = F.transform(said, lambda t, i: F.struct(i.cast("bigint").alias("turn"), canonical_role(t["role"]).alias("role"),
                                                          t["text"].alias("text")))
        turns = F.when(mine, own).otherwise(turns)
    reason = (F.when(F.col("parsed").isNull(), "no JSON").when(F.col("layout").isNull(), "no layout")
              .when(F.col("foreign"), "an element is no message").when(F.size("turns") == 0, "no turns"))
    read = marked.withColumns({"turns": turns, "foreign": foreign}).withColumn("reason", reason)
    kept = read.filter("reason is null").select("conv_id", F.explode("turns").alias("t"))
    return (kept.select("conv_id", "t.turn", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text")),
            read.filter("reason is not null").select("conv_id", "record", "reason"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, OPENER + r"(\\*)" + INSIDE, r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, OPENER + r"(\\*)\\" + INSIDE, "$1$2")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: formatted string, number of turns, loss_spans (start from 0, length)."""
    head = F.concat(F.lit(BEGIN), F.url_encode("role"), F.lit("\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pieces = (turns.withColumn("head", head).withColumn("body", escaped(F.col("text")))
              .withColumn("piece", F.concat("head", "body", F.lit(END)))
              .withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .select("conv_id", F.struct(
                  (F.col("end") - F.length("piece")).alias("start"), "piece", (F.col("role") == TRAINED_ROLE).alias("trained"),
                  F.length("head").alias("head"), F.length("body").alias("body")).alias("p")))
    joined = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return joined.select(
        "conv_id", F.size("p").cast("long").alias("n_turns"), F.array_join("p.piece", "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["trained"]), lambda x: F.struct(
            (x["start"] + x["head"]).alias("start"), x["body"].alias("length"))).alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    pieces = F.filter(F.split(text, re.escape(END)), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(BEGIN) + 1))
    return F.transform(pieces, lambda p: F.struct(
        F.url_decode(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescaped(F.substr(p, F.locate("\n", p) + 1)).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, restored."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substr(text, (s["start"] + 1).cast("int"), s["length"]))), "")
