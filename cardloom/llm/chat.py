"""Chat formatting into budgeted, turn-aligned windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Fixed values of the template, and the control strings that texts must not hold.
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Words that a turn's marks count beside its own.
TURN_WORDS = 4


def escape(text: Column) -> Column:
    """Double backslashes, then break each control string by a backslash after its first character.

    Runs of backslashes are even after the first step, so a single one can only be a break.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for c in CONTROLS:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"))


def _placed(turns: DataFrame, budget: int, history: int, block: int) -> DataFrame:
    """Turns with their number ``_i`` and place ``_p`` in the running count, both within the conversation, without its system turn
    (``_sys``, its size, or 0; ``_m``, a turn's size, is 0 for it), and ``_room``, what a window's own turns may come to."""
    rows = turns.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("_c"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))).cast("long").alias("_b"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("_n", word_count(F.col("text")) + TURN_WORDS)
    order = Window.partitionBy("_c", "_b").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_q": F.coalesce(F.sum("_n").over(order), F.lit(0)), "_j": F.count(F.lit(1)).over(order)}).drop("turn")
    rows = written(rows, "turns")
    upto = Window.partitionBy("_c").orderBy("_b")
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.max(F.when((F.col("_j") == 0) & (F.col("role") == "system"), F.col("_n")))
    sums = rows.groupBy("_c", "_b").agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_count"), F.coalesce(opening, F.lit(0)).alias("_open"))
    blocks = sums.select(
        "_c", "_b", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_q0"), F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_j0"),
        F.first("_open").over(upto).alias("_sys"))
    i, system = F.col("_j") + F.col("_j0"), F.col("_sys")
    return rows.join(blocks, ["_c", "_b"]).select(
        "conv_id", "_c", "role", "text", i.alias("_i"), "_sys",
        F.when(i == 0, F.lit(0)).otherwise(F.col("_q") + F.col("_q0") - system).cast("long").alias("_p"),
        F.when((i == 0) & (system > 0), F.lit(0)).otherwise(F.col("_n")).cast("long").alias("_m"),
        F.greatest(F.lit(budget - history) - system, F.lit(1)).cast("long").alias("_room"))


def _windows(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """Windows without their texts: ``_c``, ``window``, ``_own`` (numbers, places and sizes of turns), ``_start``, ``_i0`` (the first turn's),
    ``_sys``, and ``_back``, how far before its start a window repeats turns."""
    cells = placed.groupBy("_c", F.floor(F.col("_p") / F.col("_room")).cast("long").alias("_cell"), "_sys", "_room").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_p", "_m"))).alias("_all"))
    first, last = F.element_at("_all", 1), F.element_at("_all", -1)
    over = (last["_p"] + last["_m"] - first["_p"] > F.col("_room")) & (last["_p"] > first["_p"])
    two = F.array(
        F.struct((2 * F.col("_cell")).alias("window"), F.slice("_all", 1, F.size("_all") - 1).alias("_own")),
        F.struct((2 * F.col("_cell") + 1).alias("window"), F.slice("_all", -1, 1).alias("_own")))
    one = F.array(F.struct((2 * F.col("_cell")).alias("window"), F.col("_all").alias("_own")))
    found = cells.select("_c", "_sys", F.inline(F.when(over, two).otherwise(one)))
    first, last = F.element_at("_own", 1), F.element_at("_own", -1)
    size = last["_p"] + last["_m"] - first["_p"]
    return found.select(
        "_c", "window", "_own", "_sys", first["_p"].alias("_start"), first["_i"].alias("_i0"),
        F.least(F.lit(history), F.lit(budget) - F.col("_sys") - size).alias("_back"))


def format_windows(turns: DataFrame, budget: int = 512, history: int = 128, block: int = 64, spread: int = 512) -> DataFrame:
    """Format conversations (``conv_id``, ``turn``, ``role``, ``text``) into windows for training.

    Turns go by (turn, role, text), null turns first; null role or text is empty. A turn counts its
    words and ``TURN_WORDS``. A window has own turns, whole and in a row, and before them repeats the
    system turn (a first turn of role ``system``) and the turns that precede it within ``history``
    counts; these are masked. All of a window comes to ``budget`` at most, unless the system turn
    and a single own turn are more by themselves: that window has these two alone. Each assistant text
    is a target in one window only.

    The running count, without the system turn, is cut into cells of what ``budget`` leaves beside the system
    turn and ``history``. Turns that begin in a cell are a window; if they come to more than a cell, the
    last is a window by itself. Repeated turns shrink where a long turn leaves less than ``history``.

    Returns ``conv_id``, ``window`` (rising, with gaps), ``n_context`` (repeated turns), ``n_turns`` (own turns),
    ``formatted`` and ``loss_spans`` (start and length in code points, of escaped texts). Rows of a
    null ``conv_id`` are one conversation; other columns are left out. An empty table gives an empty table.

    Prefix sums are taken within blocks of ``block`` turn numbers and over the blocks' totals. Windows are planned
    without texts; each text then meets the windows that hold it, the system turn in one copy for each ``spread``
    windows, so a very long conversation is spread over tasks.
    """
    if history >= budget:
        raise ValueError("history must be less than budget")
    placed = written(_placed(turns, budget, history, block), "placed")
    windows = written(_windows(placed, budget, history), "windows")
    is_system = (F.col("_i") == 0) & (F.col("_sys") > 0)
    band = lambda c: F.floor(F.col(c) / max(history, 1))
    near = placed.where(~is_system).select("_c", "_i", "_p", F.explode(F.array(band("_p"), band("_p") + 1)).alias("_band"))
    later = windows.where("_back > 0 and _i0 > 0").select("_c", "window", "_start", "_i0", "_back", band("_start").alias("_band"))
    past = near.join(later, ["_c", "_band"]).where("_i < _i0 and _p >= _start - _back").select("_c", "window", "_i", F.lit(True).alias("again"), F.lit(0).cast("long").alias("_salt"))
    own = windows.select("_c", "window", F.explode("_own._i").alias("_i"), F.lit(False).alias("again"), F.lit(0).cast("long").alias("_salt"))
    salt = F.floor(F.col("window") / spread).cast("long")
    system = windows.where("_sys > 0 and _i0 > 0").select("_c", "window", F.lit(0).cast("long").alias("_i"), F.lit(True).alias("again"), salt.alias("_salt"))
    last = windows.groupBy("_c").agg(F.max("window").alias("window"))
    said = ["conv_id", "_c", "_i", "role", "text"]
    texts = placed.where(~is_system).select(*said, F.lit(0).cast("long").alias("_salt")).unionByName(
        placed.where(is_system).join(last, "_c").select(*said, F.explode(F.sequence(F.lit(0).cast("long"), salt)).alias("_salt")))
    windows = own.unionByName(past).unionByName(system).join(texts, ["_c", "_i", "_salt"]).groupBy("conv_id", "_c", "window").agg(
        F.count_if("again").alias("n_context"), F.array_sort(F.collect_list(F.struct("_i", "role", "text"))).alias("_every"))
    pieces = F.transform("_every", lambda t: F.struct(
        _head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("target")))
    tail = f"{END}\n"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.char_length(t["head"])
        span = F.array(F.struct(begin.alias("start"), F.char_length(t["body"]).alias("len")))
        own = t["target"] & (acc["i"] >= F.col("n_context"))
        return F.struct(
            (begin + F.char_length(t["body"]) + len(tail)).alias("at"), (acc["i"] + 1).alias("i"),
            F.when(own, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return windows.withColumn("_pieces", pieces).select(
        "conv_id", "window",
        "n_context", (F.size("_every") - F.col("n_context")).cast("long").alias("n_turns"),
        F.array_join(F.transform("_pieces", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("_pieces", zero, step)["spans"].alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Read formatted windows back: ``turns`` (role and text of the turns that are not repeats) and ``targets``
    (unescaped texts under the loss mask), per ``conv_id`` and ``window``."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_context").cast("int") + 2, F.col("n_turns").cast("int"))

    def turn(segment: Column) -> Column:
        role = F.substring_index(segment, "\n", 1)
        size = F.char_length(segment) - F.char_length(role) - 1 - len(END) - 1
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substring(segment, F.char_length(role) + 2, size)).alias("text"))

    return windows.select(
        "conv_id", "window", "formatted",
        F.transform(segments, turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["len"]))).alias("targets"),
    )
