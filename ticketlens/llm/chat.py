"""Chat formatting in budgeted windows, with built-in expressions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns. A span holds the turns
that lie inside one stretch of ``body`` tokens; a turn that crosses a border is a span of its own.
Each window is the conversation's system turn (if its first turn is one), the turns of the last
``history`` tokens before the span, and the span. Only the span's assistant turns carry the loss
mask, so every assistant text is a target exactly once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Control strings inside texts get a
backslash after their first character (one more than they already have), which is undone on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 128
TURN_TOKENS = 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: what a tokenizer would take for markup, after its first character
CONTROL = r"/?s>|/?INST\]|/?<?/?SYS>>|\|[A-Za-z_]+\|>"
#: rough tokens: pieces of up to four letters, up to three digits, single other signs
PIECES = r"\p{L}{1,4}|\p{N}{1,3}|[^\p{L}\p{N}\x09-\x0D\x20]"


def escape(text: Column) -> Column:
    """Break control strings; any text survives ``unescape(escape(text))``."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _escape_role(role: Column) -> Column:
    """As ``escape``; line feeds, which end a role, are written as %0A."""
    plain = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return escape(plain)


def _unescape_role(role: Column) -> Column:
    plain = F.replace(unescape(role), F.lit("%0A"), F.lit("\n"))
    return F.replace(plain, F.lit("%25"), F.lit("%"))


def turn_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECES)) + TURN_TOKENS


def format_chat(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (ascending within the conversation), text, n_turns,
    n_repeated (leading turns that an earlier window had as its own), n_tokens, loss_spans (array
    of start, length in characters of ``text``).

    ``turns``: conv_id, turn, role, text. Null role or text: empty; null turn numbers come first;
    rows of equal turn go by role, then text; repeated rows are turns of their own; a null conv_id
    is one conversation. Other columns are not read. A window exceeds the budget only if a single
    turn does not fit with the system turn and the history. No rows, no windows.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn(
        "n", F.count("*").over(conv))
    system = (F.col("seq") == 1) & (F.col("role") == "system") & (F.col("n") > 1)
    content = F.struct("seq", "role", "text")
    rows = (
        rows.withColumn("system", system)
        .withColumn("head", F.first(F.when(F.col("system"), content)).over(order))
        .withColumn("head_tokens", F.first(F.when(F.col("system"), F.col("tokens"))).over(order))
        .withColumn("start", F.coalesce(
            F.sum(F.when(~F.col("system"), F.col("tokens"))).over(
                order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .filter(~F.col("system"))
    )
    body = F.greatest(budget - history - F.coalesce("head_tokens", F.lit(0)), F.lit(1))
    cell = F.floor(F.col("start") / body)
    crosses = F.floor((F.col("start") + F.col("tokens") - 1) / body) > cell
    recent = conv.orderBy("start").rangeBetween(-history, -1)
    rows = rows.withColumn("window", cell * 2 + crosses.cast("long")).withColumn(
        "before", F.collect_list(F.struct("seq", "role", "text", "tokens")).over(recent))
    windows = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("seq", "role", "text", "tokens"))).alias("own"),
        F.min_by("before", "seq").alias("before"),
        F.first("head").alias("head"),
        F.first("head_tokens").alias("head_tokens"),
    )
    first = F.when(F.col("head").isNull(), 1).otherwise(2)
    opening = F.col("own")[0]["seq"] == first

    def turn(t: Column, target: Column) -> Column:
        lead = F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n"))
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("text"), target.alias("target"))

    no = F.lit(False)
    parts = F.concat(
        F.when(F.col("head").isNotNull(), F.array(turn(F.col("head"), no))).otherwise(
            F.array().cast("array<struct<lead:string,text:string,target:boolean>>")),
        F.transform(F.sort_array("before"), lambda t: turn(t, no)),
        F.transform("own", lambda t: turn(t, t["role"] == "assistant")),
    )
    repeated = F.size("before") + F.when(F.col("head").isNotNull() & ~opening, 1).otherwise(0)
    tokens = F.aggregate(F.concat("before", "own"), F.coalesce("head_tokens", F.lit(0)),
                         lambda n, t: n + t["tokens"])
    laid = windows.select("conv_id", "window", parts.alias("parts"),
                          repeated.cast("int").alias("n_repeated"), tokens.alias("n_tokens"))
    empty = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["lead"]) + F.length(p["text"]) + len(CLOSE)).alias("at"),
            F.when(p["target"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(p["lead"])).alias("start"),
                F.length(p["text"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    text = F.array_join(
        F.transform("parts", lambda p: F.concat(p["lead"], p["text"], F.lit(CLOSE))), "")
    return laid.select("conv_id", "window", text.alias("text"), F.size("parts").alias("n_turns"),
                       "n_repeated", "n_tokens", spans.alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per window of ``format_chat``: conv_id, window, turns (array of role, text, without the
    repeated ones) and targets (the texts under the loss mask), all unescaped."""
    pieces = F.split("text", r"<\|im_end\|>\n", -1)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))

    def parse(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, len(OPEN) + 1, F.length(piece)), "\n", 1)
        at = F.lit(len(OPEN)) + F.length(role) + 2
        return F.struct(_unescape_role(role).alias("role"),
                        unescape(F.substring(piece, at, F.length(piece))).alias("text"))

    targets = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.transform(own, parse).alias("turns"),
                          targets.alias("targets"), "text")


def chat_digest(windows: DataFrame) -> DataFrame:
    """What a reader gets back, per conversation: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_windows. The digest of a conversation needs its texts in one value."""
    back = read_back(windows).select(
        "conv_id", "window",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"),
        F.length("text").cast("long").alias("chars"),
    )
    whole = back.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    loss = F.array_join(F.col("w.loss"), "")
    return whole.select(
        "conv_id", "n_turns",
        F.sha2(F.array_join(F.col("w.turns"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )
