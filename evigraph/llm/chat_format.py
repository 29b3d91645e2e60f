"""Chat formatting: a declarative template, a finite-state machine over roles, loss masks.

All of it is DataFrame expressions. A `Template` says how a turn is marked, which
roles may follow which, and whose texts count for the loss. `segments` gives the
text segments with their loss flags; their concatenation is the formatted string.

Control strings inside texts are escaped with a backslash: ``\\`` becomes ``\\\\``
and ``<|`` becomes ``<\\|``, so that a formatted string holds no control string
but those of the template, and taking one backslash away from each escape gives
the text back. In a role, a newline becomes a backslash and an n as well, so that
it doesn't end the role.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """before + role + between + text + after for each turn; `follows` is the machine's table, from "" at the start."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a backslash before n is an escape of its own after an even number of backslashes only
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>), in order of turn; ties by role, then text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def state_after(roles: Column, template: Template = CHAT) -> Column:
    """The machine's state: the last role, or null from the first turn on that no transition allows."""
    table = F.create_map(*[x for k, v in template.follows.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.aggregate(roles, F.lit(""), lambda s, r: F.when(F.array_contains(F.element_at(table, s), r), r))


def segments(turns: Column, template: Template = CHAT) -> Column:
    """array<struct<text, loss>>: control strings and texts, one after the other."""
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                part(F.concat(F.lit(template.before), escape_role(t["role"]), F.lit(template.between)), no),
                part(escape(t["text"]), t["role"].isin(*template.loss)),
                part(F.lit(template.after), no),
            ),
        )
    )


def chat_format(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, valid, segments, mask, formatted) for every conv_id of conversations (conv_id, turn, role, text).

    mask: the runs of `formatted`, each with its length in code points and
    whether its characters count for the loss. valid: the machine accepts the roles from the first turn to the last.
    Conversations that it rejects are formatted all the same. Null roles and
    texts are empty; a null turn comes first, equal turns go by role, then text;
    repeated rows are turns of their own; null is a conv_id like any other.
    Other columns are ignored; no rows, no result.
    """
    t = turns(conversations).withColumn("segments", segments(F.col("turns"), template))
    end = state_after(F.transform("turns", lambda x: x["role"]), template)
    mask = F.transform("segments", lambda s: F.struct(F.length(s["text"]).cast("long").alias("chars"), s["loss"].alias("loss")))
    return t.select("conv_id", F.coalesce(end.isin(*template.final), F.lit(False)).alias("valid"), "segments", mask.alias("mask"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def under_loss(formatted: Column, mask: Column) -> Column:
    """array<string>: what stands under the runs of a formatted string's mask that count, in order."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("said"))

    def run(s: Column, m: Column) -> Column:
        here = F.array(F.substr(formatted, s["at"].cast("int"), m["chars"].cast("int")))
        return F.struct((s["at"] + m["chars"]).alias("at"), F.when(m["loss"], F.concat(s["said"], here)).otherwise(s["said"]).alias("said"))

    return F.aggregate(mask, start, run)["said"]


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """array<struct<role, text>> of a formatted string."""
    whole = F.split(formatted, "\\Q" + template.after + "\\E", -1)
    one = F.slice(whole, 1, F.size(whole) - 1)

    def turn(x: Column) -> Column:
        x = F.substr(x, F.lit(len(template.before) + 1))
        cut = F.instr(x, template.between)
        return F.struct(unescape_role(F.substr(x, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(x, cut + len(template.between))).alias("text"))

    return F.transform(one, turn)
