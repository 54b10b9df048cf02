"""Chat formatting with built-in functions only.

A template says in data how a turn is marked, which strings are control strings, which roles carry loss and which role
may follow which. A finite-state machine over the roles (its state is the role read last) validates the order of
turns; every turn is emitted as segments with a loss flag each. Inside roles and texts a backslash is put before every
backslash and into every control string, so no control string is left there and the texts can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

START = ""


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is written ``open`` role ``close`` text ``end``."""

    open: str = "<|"
    close: str = "|>\n"
    end: str = "</s>\n"
    #: Strings that must not occur inside a text; each has at least two characters and no backslash.
    controls: tuple[str, ...] = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: From each state (the role before, or START) the roles that may follow.
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
        return out

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def follows(self, state: Column, role: Column) -> Column:
        """Whether the machine accepts ``role`` in ``state``."""
        ok = F.lit(False)
        for s, roles in self.transitions.items():
            ok = ok | ((state == s) & role.isin(*roles))
        return ok


DEFAULT = ChatTemplate()


def segments(turns: DataFrame, template: ChatTemplate = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Three rows per turn: conv_id, turn_no, part (0 mark, 1 text, 2 end), segment, loss, start, accepted.

    ``start`` is the segment's place in the formatted conversation, in code points. Null roles and texts count as
    empty; a null conversation id is a conversation. Turns that tie (or have no number, these first) are in the order of
    role and text, and repeated rows are turns each. ``accepted`` tells whether the role may follow the one before. The
    turns of a conversation meet in one task (and in ``formatted`` in one row), those with a null id as well.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({
        "mark": F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.close)),
        "body": template.escape(F.col("text")),
        "turn_no": F.row_number().over(order) - 1,
        "accepted": template.follows(F.coalesce(F.lag("role").over(order), F.lit(START)), F.col("role")),
    })
    size = F.length("mark") + F.length("body") + len(template.end)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = lambda k, segment, loss, start: F.struct(F.lit(k).alias("part"), segment.alias("segment"), loss.alias("loss"), start.alias("start"))
    parts = F.array(
        part(0, F.col("mark"), F.lit(False), F.col("at")),
        part(1, F.col("body"), F.col("role").isin(*template.loss_roles), F.col("at") + F.length("mark")),
        part(2, F.lit(template.end), F.lit(False), F.col("at") + F.length("mark") + F.length("body")),
    )
    return rows.select("conv_id", "turn_no", "accepted", "role", F.inline(parts))


def formatted(turns: DataFrame, template: ChatTemplate = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points), valid, complete.

    ``valid``: every role may follow the one before. ``complete``: valid, and the last role is a final one. All
    conversations are formatted, valid or not; an empty table gives an empty result.
    """
    s = segments(turns, template, conv, turn, role, text)
    listed = F.sort_array(F.collect_list(F.struct("turn_no", "part", "segment", "loss", "start")))
    rows = s.groupBy("conv_id").agg(listed.alias("s"), F.min("accepted").alias("valid"), F.max_by("role", F.col("turn_no")).alias("last"))
    return rows.select(
        "conv_id",
        F.array_join(F.col("s.segment"), "").alias("formatted"),
        F.transform(F.filter("s", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), F.length(x["segment"]).cast("long").alias("length"))).alias("loss_spans"),
        "valid",
        (F.col("valid") & F.col("last").isin(*template.final)).alias("complete"),
    )


def read_turns(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    bodies = F.filter(F.split(formatted, re.escape(template.end)), lambda x: x != "")
    close = F.lit(template.close)
    return F.transform(bodies, lambda x: F.struct(
        template.unescape(F.substring_index(F.substr(x, F.lit(len(template.open) + 1)), template.close, 1)).alias("role"),
        template.unescape(F.substr(x, F.position(close, x) + len(template.close))).alias("text"),
    ))


def read_loss(formatted: Column, spans: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The text under the loss mask, unescaped, nothing between the pieces."""
    return F.array_join(F.transform(spans, lambda s: template.unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(turns: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Format, read back, and return per conversation what came back: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, valid, complete."""
    back = formatted(turns, template).withColumns({"turns": read_turns(F.col("formatted"), template), "loss": read_loss(F.col("formatted"), F.col("loss_spans"), template)})
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "complete")
