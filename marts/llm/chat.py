"""Chat formatting in token-budgeted windows, in DataFrame functions only.

A conversation's turns become one or more training texts (windows). Prefix sums of
the turns' tokens place each turn on its conversation's token line; the line is cut
at multiples of a stride, at turn borders. Every window starts with the
conversation's system turn and with as many turns of the window before as fit in
``history`` tokens and in the room that the system turn and the new turns leave. Those
are repeated for context only: the loss mask covers each assistant text once, in the
window where it is new.

Budget: stride = budget - history - system tokens - reserve. A turn that crosses a
cut stays in the window where it starts, which is what ``reserve`` is kept for. A
turn longer than ``reserve`` is the only new one of its window, and so is every turn where
the system turn leaves no stride. ``n_tokens`` passes the budget only if a window's one new
turn and the system turn do so by themselves; nothing is cut or dropped.

Template: ``<s>[ROLE]role[/ROLE]text</s>`` per turn. Each control string inside a
role or text gets a backslash behind its first bracket (one more if it already has
some), so the text holds no control string and the step is undone exactly.

Tokens of a turn: runs of ASCII letters and digits, and each other character that
is not blank, plus ``MARK_TOKENS`` for the template.

Scale: prefix sums run inside blocks of ``BLOCK_TURNS`` turn numbers and then over
the blocks' sums, so no window function sees a whole long conversation. A window of
text is built by one task and is bounded by the budget.

Defined cases: null text and null role are empty; turns are ordered by turn (null
first), equal ones by role and text, repeated rows stay; rows with a null
conversation form one; an empty table gives no window. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 256
RESERVE = 512
MARK_TOKENS = 4
BLOCK_TURNS = 64

#: Fixed strings of the template and of its family; all are escaped inside texts.
TURN_OPEN, ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<s>", "[ROLE]", "[/ROLE]", "</s>"
_CONTROL = r"(\[/?|</?)(\\*)(ROLE\]|INST\]|s>)"
_ESCAPED = r"(\[/?|</?)\\(\\*)(ROLE\]|INST\]|s>)"
_TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    empty = F.lit("")
    body = F.coalesce(F.col(text), empty)
    return conversations.select(
        F.col(conv).alias("conv"),
        # One order for null and number: null first.
        F.struct(F.col(turn).isNotNull().alias("has"), F.col(turn).alias("turn")).alias("at"),
        F.coalesce(F.floor(F.col(turn) / BLOCK_TURNS), F.lit(-1 << 60)).cast("long").alias("block"),
        escape(F.coalesce(F.col(role), empty)).alias("role"),
        escape(body).alias("text"),
        (F.regexp_count(body, F.lit(_TOKEN)) + MARK_TOKENS).cast("long").alias("tokens"),
    )


def _placed(turns: DataFrame, budget: int, history: int, reserve: int) -> DataFrame:
    """Each turn with its token prefix, number, stride and the cell it starts in."""
    long = (F.col("tokens") > reserve).cast("long")
    one = F.lit(1).cast("long")
    order = ("at", "role", "text")
    first = F.struct("at", "role", "text", "tokens")
    blocks = turns.groupBy("conv", "block").agg(
        F.sum("tokens").alias("sum_tokens"),
        F.sum(long).alias("sum_long"),
        F.count(one).alias("sum_turns"),
        F.min(first).alias("first"),
    )
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    head = F.first("first").over(whole)
    blocks = blocks.select(
        F.col("conv").alias("b_conv"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("sum_tokens").over(before), zero).alias("b_tokens"),
        F.coalesce(F.sum("sum_long").over(before), zero).alias("b_long"),
        F.coalesce(F.sum("sum_turns").over(before), zero).alias("b_turns"),
        F.when(head["role"] == "system", head).alias("system"),
    )
    own = Window.partitionBy("conv", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select(
        "*",
        F.coalesce(F.sum("tokens").over(own), zero).alias("p"),
        F.coalesce(F.sum(long).over(own), zero).alias("l"),
        (F.row_number().over(Window.partitionBy("conv", "block").orderBy(*order)) - 1).alias("k"),
    )
    rows = rows.join(
        blocks, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block"))
    )
    stride = F.greatest(
        F.lit(budget - history - reserve) - F.coalesce(F.col("system.tokens"), zero), one
    )
    start, longs = F.col("p") + F.col("b_tokens"), F.col("l") + F.col("b_long")
    return rows.select(
        "conv",
        (F.col("k") + F.col("b_turns")).alias("number"),
        "role",
        "text",
        "tokens",
        start.alias("start"),
        (longs * 2 + long).alias("segment"),
        F.when(F.col("tokens") > reserve, zero).otherwise(F.floor(start / stride)).alias("cell"),
        F.col("system"),
    )


def chat_windows(
    conversations: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    reserve: int = RESERVE,
) -> DataFrame:
    """Windows: ``conv_id, window, text, new_at, loss, n_tokens, n_turns``.

    ``new_at`` is the number of leading code points that repeat earlier turns;
    ``loss`` holds ``(start, end)`` code point spans of the assistant texts to learn.
    """
    if budget <= history + reserve:
        raise ValueError("budget must pass history + reserve")
    turns = _placed(_turns(conversations, conv, turn, role, text), budget, history, reserve)
    cells = turns.groupBy("conv", "segment", "cell").agg(
        F.min("start").alias("at"), F.sum("tokens").alias("new"), F.first("system").alias("system")
    )
    left = F.lit(budget) - F.coalesce(F.col("system.tokens"), F.lit(0)) - F.col("new")
    room = F.greatest(F.least(F.lit(history).cast("long"), left), F.lit(0).cast("long"))
    order = Window.partitionBy("conv").orderBy("segment", "cell")
    cells = cells.select(
        F.col("conv").alias("c_conv"),
        F.col("segment").alias("c_segment"),
        F.col("cell").alias("c_cell"),
        (F.row_number().over(order) - 1).alias("window"),
        F.lead("at").over(order).alias("next_at"),
        F.lead(room).over(order).alias("next_room"),
        "system",
    )
    placed = turns.drop("system").join(
        cells.drop("system"),
        F.col("conv").eqNullSafe(F.col("c_conv"))
        & (F.col("segment") == F.col("c_segment"))
        & (F.col("cell") == F.col("c_cell")),
    )
    is_system = (F.col("number") == 0) & (F.col("role") == "system")
    again = (F.col("next_at") - F.col("start") <= F.col("next_room")) & ~is_system
    entry = lambda window, kind: F.struct(window.alias("window"), F.lit(kind).alias("kind"))
    rows = placed.select(
        "conv",
        F.explode(
            F.when(
                again, F.array(entry(F.col("window"), 2), entry(F.col("window") + 1, 1))
            ).otherwise(F.array(entry(F.col("window"), 2)))
        ).alias("to"),
        "number",
        "role",
        "text",
        "tokens",
    ).select("conv", "to.window", "to.kind", "number", "role", "text", "tokens")
    systems = cells.where((F.col("window") > 0) & F.col("system").isNotNull()).select(
        F.col("c_conv").alias("conv"),
        "window",
        F.lit(0).alias("kind"),
        F.lit(0).cast("int").alias("number"),
        "system.role",
        "system.text",
        "system.tokens",
    )
    rows = rows.unionByName(systems)
    return (
        rows.groupBy("conv", "window")
        .agg(
            F.sort_array(F.collect_list(F.struct("kind", "number", "role", "text", "tokens"))).alias(
                "turns"
            )
        )
        .select(F.col("conv").alias("conv_id"), "window", *_rendered(F.col("turns")))
    )


def _rendered(turns: Column) -> list[Column]:
    head = lambda t: F.concat(F.lit(TURN_OPEN + ROLE_OPEN), t["role"], F.lit(ROLE_CLOSE))
    shown = lambda t: F.concat(head(t), t["text"], F.lit(TURN_CLOSE))
    new = F.filter(turns, lambda t: t["kind"] == 2)
    old = F.filter(turns, lambda t: t["kind"] < 2)
    length = lambda ts: F.aggregate(
        ts, F.lit(0).cast("long"), lambda n, t: n + F.length(shown(t))
    )
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    walked = F.aggregate(
        new,
        F.struct(length(old).alias("at"), spans.alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(shown(t))).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(head(t))).cast("long").alias("start"),
                            (a["at"] + F.length(head(t)) + F.length(t["text"])).cast("long").alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return [
        F.array_join(F.transform(turns, shown), "").alias("text"),
        length(old).alias("new_at"),
        walked["spans"].alias("loss"),
        F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
        F.size(turns).alias("n_turns"),
    ]


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation the turns and the learnt text, from the windows' texts alone.

    A digest of a whole conversation needs its whole text in one task; the windows
    arrive there already joined, one string each.
    """
    fresh = F.expr("substring(text, cast(new_at + 1 as int))")
    parts = F.filter(F.split(fresh, r"</s>"), lambda t: t != "")
    marker = F.lit(TURN_OPEN + ROLE_OPEN)
    role = lambda t: F.substring_index(F.substr(t, F.length(marker) + 1), ROLE_CLOSE, 1)
    body = lambda t: F.substr(
        t, F.length(marker) + F.length(role(t)) + len(ROLE_CLOSE) + 1
    )
    learnt = F.transform(
        "loss",
        lambda s: unescape(
            F.substr(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        ),
    )
    pieces = windows.select(
        "conv_id",
        "window",
        F.size(parts).cast("long").alias("n"),
        F.array_join(
            F.transform(
                parts, lambda t: F.concat(unescape(role(t)), F.lit("\n"), unescape(body(t)), F.lit("\n"))
            ),
            "",
        ).alias("turns"),
        F.array_join(learnt, "").alias("learnt"),
        F.length("text").cast("long").alias("chars"),
    )
    joined = lambda c: F.array_join(
        F.transform(F.col("all"), lambda w: w[c]), ""
    )
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return (
        pieces.groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("window", "turns", "learnt"))).alias("all"),
            F.sum("n").alias("n_turns"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            digest(joined("turns")).alias("turns_sha256"),
            F.length(joined("learnt")).cast("long").alias("loss_chars"),
            digest(joined("learnt")).alias("loss_sha256"),
            "formatted_chars",
        )
    )
