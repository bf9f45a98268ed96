"""Chat formatting by schema fingerprint, in DataFrame functions only.

A record may come in any of the declared ``LAYOUTS``. The fingerprint of a row is the SHA-256
of the nested paths of the layout fields that are not null in it; it selects the mapping that
turns the row into canonical turns, an array of (role, text). The template puts marks around
each turn and escapes what looks like a mark inside roles and texts, so that turns and the
loss mask can be read back exactly.

Rules: null texts are empty and null roles are empty, and so formatted; an empty list of turns
gives an empty output. Rows whose fingerprint no layout has keep null turns and the layout
'unknown'. Columns that no layout names are kept and do not enter the fingerprint; a layout
field of another type changes the fingerprint, so it selects nothing. Repeated rows are
formatted each.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``each`` names a list with its role and text fields; otherwise ``turns`` lists (role, columns)."""

    name: str
    paths: tuple[str, ...]
    each: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fields(self) -> set[str]:
        return {path.split("[")[0].split(".")[0] for path in self.paths}


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout(
        "conversations",
        ("conversations[].from", "conversations[].value"),
        ("conversations", "from", "value"),
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Layout("prompt", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout(
        "system_prompt",
        ("completion", "prompt", "system"),
        turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))),
    ),
    Layout(
        "instruction",
        ("instruction", "output"),
        turns=(("user", ("instruction",)), ("assistant", ("output",))),
    ),
    Layout(
        "instruction_input",
        ("input", "instruction", "output"),
        turns=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
)


def nested_paths(name: str, kind: T.DataType) -> list[str]:
    """Paths of the leaves of a field; leaves that are not strings carry their type."""
    if isinstance(kind, T.StructType):
        return [path for field in kind for path in nested_paths(f"{name}.{field.name}", field.dataType)]
    if isinstance(kind, T.ArrayType):
        return nested_paths(f"{name}[]", kind.elementType)
    return [name if isinstance(kind, T.StringType) else f"{name}:{kind.simpleString()}"]


def fingerprint_of(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def fingerprint(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Fingerprint of a row from the layout fields of ``schema`` that are not null in it."""
    named = set().union(*(layout.fields for layout in layouts))
    parts = [
        F.when(F.col(f"`{f.name}`").isNotNull(), F.array(*map(F.lit, nested_paths(f.name, f.dataType))))
        for f in schema
        if f.name in named
    ]
    none = F.array().cast("array<string>")
    found = F.flatten(F.array(none, *(F.coalesce(part, none) for part in parts)))
    return F.sha2(F.array_join(F.array_sort(found), ","), 256)


def _mapping(layout: Layout) -> Column:
    if layout.each:
        items, role, text = layout.each

        def turn(item: Column) -> Column:
            name = item[role]
            for was, now in layout.roles:
                name = F.when(item[role] == was, F.lit(now)).otherwise(name)
            return F.struct(
                F.coalesce(name, F.lit("")).alias("role"), F.coalesce(item[text], F.lit("")).alias("text")
            )

        return F.transform(F.filter(items, lambda item: item.isNotNull()), turn).cast(TURNS)
    return F.array(
        *(
            F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *columns).alias("text"))
            for role, columns in layout.turns
        )
    ).cast(TURNS)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` and ``turns`` to records of mixed layouts."""
    shapes = {f.name: nested_paths(f.name, f.dataType) for f in records.schema}
    key = F.col("_fingerprint")
    turns, name = F.lit(None).cast(TURNS), F.lit("unknown")
    for layout in layouts:
        here = [path for field in sorted(layout.fields) for path in shapes.get(field, [])]
        if sorted(here) != sorted(layout.paths):
            continue  # no row of this schema can have the layout
        chosen = key == fingerprint_of(layout.paths)
        turns = F.when(chosen, _mapping(layout)).otherwise(turns)
        name = F.when(chosen, F.lit(layout.name)).otherwise(name)
    return (
        records.withColumn("_fingerprint", fingerprint(records.schema, layouts))
        .withColumns({"layout": name, "turns": turns})
        .drop("_fingerprint")
    )


def escape(text: Column) -> Column:
    """Doubles backslashes and parts every ``<|`` by one."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(
        parts,
        lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")),
    )
    return F.when(F.contains(text, F.lit("\\")), F.array_join(plain, "\\")).otherwise(text)


def _escaped_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_turns(records: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``, the code point ranges of the assistant's texts in it."""
    rendered = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learned"),
        ),
    )
    start = "array<struct<start:int,end:int>>"
    walked = F.aggregate(
        "_rendered",
        F.struct(F.lit(0).alias("at"), F.array().cast(start).alias("mask")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(
                t["learned"],
                F.concat(
                    acc["mask"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(t["head"])).alias("start"),
                            (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )
    whole = F.array_join(F.transform("_rendered", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return (
        records.withColumn("_rendered", rendered)
        .withColumns({"formatted": whole, "loss_mask": walked["mask"]})
        .drop("_rendered")
    )


def parse(formatted: Column) -> Column:
    """Turns of a formatted text."""
    parts = F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda part: part != "")

    def turn(part: Column) -> Column:
        role = F.substring_index(F.substring(part, len(START) + 1, 1 << 30), "\n", 1)
        text = F.substr(part, F.length(role) + len(START) + 2)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, without anything between."""
    return F.array_join(
        F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["end"] - m["start"]))), ""
    )


def records_of(rows: DataFrame) -> DataFrame:
    """One record per conversation from rows (conv_id, turn, role, text), in mixed layouts.

    Turns are ordered by turn; rows of one turn by role and text, so that order is defined.
    A question with its answer becomes a prompt record, with a system text before it a system
    prompt record, all else a list of messages."""
    listed = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all")
    )
    roles = F.transform("all", lambda t: t["role"])
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    three = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    text = lambda n: F.coalesce(F.element_at("all", n)["text"], F.lit(""))
    pair, three = F.coalesce(pair, F.lit(False)), F.coalesce(three, F.lit(False))
    return listed.select(
        "conv_id",
        F.when(three, text(1)).alias("system"),
        F.when(pair | three, text(-2)).alias("prompt"),
        F.when(pair | three, text(-1)).alias("completion"),
        F.when(
            ~(pair | three),
            F.transform(
                "all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))
            ),
        ).alias("messages"),
    )


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, layout, formatted, loss_mask) of rows (conv_id, turn, role, text)."""
    formatted = format_turns(canonical_turns(records_of(rows)))
    return formatted.select("conv_id", "layout", "formatted", "loss_mask")


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of the query, read back from ``formatted`` and ``loss_mask`` alone."""
    learned = masked_text(F.col("formatted"), F.col("loss_mask"))
    told = F.array_join(
        F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return (
        formatted.withColumns({"_turns": parse(F.col("formatted")), "_learned": learned})
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            F.sha2(told, 256).alias("turns_sha256"),
            F.length("_learned").cast("long").alias("loss_chars"),
            F.sha2("_learned", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
