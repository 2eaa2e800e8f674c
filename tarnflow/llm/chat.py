r"""Chat formatting from typed content parts, with DataFrame operations only.

The template: ``<s>``, then for each turn ``[ROLE]`` role ``[/ROLE]`` body ``</s>``.  A body is the
turn's parts in order: text as it is, other parts as placeholders.  Control strings begin with ``<``
or ``[``; inside roles and texts these and the backslash become ``\a``, ``\l`` and ``\b``, so no
control string can stand in them, and every backslash that is written starts one of the three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.shared import fresh

BEGIN, END, ROLE, BODY = "<s>", "</s>", "[ROLE]", "[/ROLE]"
#: Placeholder and tokens that it expands to where a part gives no number.
PLACEHOLDERS = {"image": ("[IMAGE]", 576), "audio": ("[AUDIO]", 188), "document": ("[DOCUMENT]", 1024)}
OTHER = ("[ATTACHMENT]", 1)
PART = "struct<kind:string,text:string,ref:string,tokens:long>"
LEARNT_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("["), F.lit("\\l")), F.lit("<"), F.lit("\\a"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("[")), F.lit("\\a"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), none.alias("tokens")).cast(PART))


def _choose(kind: Column, place: int) -> Column:
    out = F.lit(OTHER[place])
    for name, values in PLACEHOLDERS.items():
        out = F.when(kind == name, F.lit(values[place])).otherwise(out)
    return out


def visit(parts: Column) -> tuple[Column, Column]:
    """The body of a turn and its attachments (kind, ref, tokens), both in the order of the parts."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    body = F.transform(parts, lambda p: F.when(is_text(p), escape(p["text"])).otherwise(_choose(p["kind"], 0)))
    attached = F.transform(
        F.filter(parts, lambda p: ~is_text(p)),
        lambda p: F.struct(
            p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], _choose(p["kind"], 1).cast("long")).alias("tokens")
        ),
    )
    return F.array_join(body, ""), attached


def format_chats(
    turns: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: Column | None = None,
    text: str = "text",
    learnt_role: str = LEARNT_ROLE,
) -> DataFrame:
    """One row a conversation: its id, ``formatted``, ``loss``, ``attachments``, ``expanded_tokens``.

    ``parts`` are typed parts (kind, text, ref, tokens); without, a turn is its ``text``.  ``loss``
    lists the bodies of ``learnt_role``: turn (from 0), offset in the turn's piece and start in the
    whole (both from 1) and length, in characters.  Starts are running sums in the conversation's
    order, so nothing is quadratic in its length.

    Turns of equal number follow role and body; a null number comes first.  A null role or text is
    empty; a null part list is an empty body; a part of unknown kind is an attachment; a null kind
    is text.  Null ids form one conversation.  An empty table gives no rows.  A conversation is one
    value, so its turns meet in one task, as its text does in one cell.
    """
    body, attached = visit(parts if parts is not None else text_part(F.col(text)))
    name = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), name.alias("role"), body.alias("body"), attached.alias("attached")
    )
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(BODY))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "body"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    width = F.length("piece") + len(END)
    rows = rows.withColumn("at", F.row_number().over(order) - 1).withColumn(
        "start", F.lit(len(BEGIN) + 1) + F.coalesce(F.sum(width).over(before), F.lit(0))
    )
    loss = F.struct(
        F.col("at").alias("turn"),
        (F.length("head") + 1).cast("long").alias("offset"),
        (F.col("start") + F.length("head")).cast("long").alias("start"),
        F.length("body").cast("long").alias("length"),
    )
    mine = F.when(F.col("role") == learnt_role, loss)
    gathered = rows.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece", "attached"))).alias("turns"),
        F.array_sort(F.collect_list(mine)).alias("loss"),
    )
    pieces = F.transform("turns", lambda t: F.concat(t["piece"], F.lit(END)))
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return gathered.select(
        F.col("conv").alias(conversation),
        F.concat(F.lit(BEGIN), F.array_join(pieces, "")).alias("formatted"),
        "loss",
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_chats(formatted: DataFrame, *, text: str = "formatted", loss: str = "loss") -> DataFrame:
    """The rows with ``turns`` (role, text) and ``learnt`` (texts under the loss mask), read back and unescaped.

    Rows stay as they are, repeated ones too.  A null conversation has null turns and nothing learnt, a
    null loss list null ``learnt``.  An empty table gives an empty table.  A clashing column name is prefixed with ``_``.
    """
    inner = F.substring(F.col(text), F.lit(len(BEGIN) + 1), F.length(text))
    split = F.split(inner, END)
    pieces = F.slice(split, F.lit(1), F.size(split) - 1)
    opened = lambda p: F.substring(F.split_part(p, F.lit(BODY), F.lit(1)), len(ROLE) + 1, 2**31 - 1)
    turns = F.transform(
        pieces, lambda p: F.struct(unescape(opened(p)).alias("role"), unescape(F.split_part(p, F.lit(BODY), F.lit(2))).alias("text"))
    )
    under = F.element_at(
        F.transform(
            F.array(pieces),
            lambda all_: F.transform(loss, lambda s: unescape(F.substring(F.get(all_, s["turn"]), s["offset"], s["length"]))),
        ),
        1,
    )
    turns_at, learnt_at = fresh(formatted, "turns", "learnt")
    return formatted.withColumns({turns_at: turns, learnt_at: under})
