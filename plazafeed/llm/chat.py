"""Chat formatting: a template given as data, a state machine over roles, and a loss flag for each segment.

DataFrame functions alone. Texts lose every character that could begin a control string to
an escape, so the formatted text splits at its control strings without doubt, and reading
it back gives the turns again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Escapes in the order they are applied; undone in reverse.
ESCAPES = [("~", "~0"), ("[", "~1"), ("<", "~2"), ("]", "~3")]


@dataclass(frozen=True)
class ChatTemplate:
    """roles: role -> (opening, closing, loss). Other roles are written between ``[ROLE name]`` and ``[/ROLE]``, without loss.

    moves: (state, role) -> state, from ``start``; a role that has no move makes the conversation invalid.
    """

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("[OUT]", "</s>", True)})
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _pick(role: Column, template: ChatTemplate, part: int, other: Column) -> Column:
    out = None
    for name, spec in template.roles.items():
        out = (F if out is None else out).when(role == name, F.lit(spec[part]))
    return other if out is None else out.otherwise(other)


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conv_id: n_turns, state (the machine's last, ``invalid`` if a turn had no move), formatted, spans.

    A turn's place is a running sum over its conversation, so the work is linear in the turns.
    spans(start, length, loss): the formatted text's segments in order, from 0; together
    they cover it. Turns are ordered by turn (null first), then role and text. A null text
    or role is empty; a null conv_id is a conversation of its own. Every conversation is
    formatted, valid or not. Other columns are ignored.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    opening = lambda r: _pick(r, template, 0, F.concat(F.lit("[ROLE "), escape(r), F.lit("]")))
    closing = lambda r: _pick(r, template, 1, F.lit("[/ROLE]"))
    sizes = t.select("*", F.length(opening(F.col("role"))).alias("head"), F.length(escape(F.col("text"))).alias("body"), F.length(closing(F.col("role"))).alias("tail"))
    whole = F.col("head") + F.col("body") + F.col("tail")
    before = (F.sum(whole).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)) - whole).cast("int")
    placed = sizes.select("conv_id", F.struct("turn", "role", "text", before.alias("at"), "head", "body", "tail").alias("x"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}>{r}", to)])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), x.role)), F.lit("invalid")))
    text = F.array_join(F.transform("turns", lambda x: F.concat(opening(x.role), escape(x.text), closing(x.role))), "")
    span = lambda at, size, loss: F.struct(at.alias("start"), size.alias("length"), loss.alias("loss"))
    spans = F.flatten(F.transform("turns", lambda x: F.array(
        span(x["at"], x["head"], F.lit(False)), span(x["at"] + x["head"], x["body"], _pick(x.role, template, 2, F.lit(False))), span(x["at"] + x["head"] + x["body"], x["tail"], F.lit(False)),
    )))
    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("state"), text.alias("formatted"), spans.alias("spans"))


def read_chats(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """What ``format_chats`` wrote, from ``formatted`` and ``spans`` alone: conv_id, turns(role, text), loss_text, formatted.

    One row per row of ``formatted``; empty texts and roles come back empty (so do null ones), and an
    empty table gives an empty one.
    """
    closings = "|".join(rf"\Q{c}\E" for c in sorted({c for _, c, _ in template.roles.values()} | {"[/ROLE]"}))
    pattern = rf"(\[[^\]]*\])([^\[<]*)({closings})"
    names = {o: r for r, (o, _, _) in template.roles.items()}

    def role(opening: Column) -> Column:
        out = F
        for o, r in names.items():
            out = out.when(opening == o, F.lit(r))
        other = unescape(F.substring(opening, 7, F.length(opening) - 7))
        return out.otherwise(other) if names else other

    openings, bodies = (F.regexp_extract_all("formatted", F.lit(pattern), k) for k in (1, 2))
    turns = F.zip_with(openings, bodies, lambda o, b: F.struct(role(o).alias("role"), unescape(b).alias("text")))
    #: Spans come in threes, the text of a turn in the middle: segments are taken as the pattern finds them, not by
    #: their places, since finding a place in a long text means counting its characters from the start.
    loss = F.array_join(F.transform(bodies, lambda x, i: F.when(F.get("spans", 3 * i + 1)["loss"], unescape(x))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted", *[c for c in ("state",) if c in formatted.columns])


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of each row of ``read``; no assistant turn: no characters under the loss mask and the digest of nothing."""
    told = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), (F.col("state") != "invalid").alias("valid"),
    )
