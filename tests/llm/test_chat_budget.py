"""Windows of conversations: their budget, what they repeat, and odd tables."""

import pytest
from pyspark.sql import functions as F

from cardloom.llm import chat

DDL = "conv_id long, turn long, role string, text string"


def says(n):
    return " ".join(["w"] * n)


def plain_windows(sizes, system, budget, history):
    """By a plain loop: the numbers of repeated and of own turns of each window of turns of these sizes (the system turn is number 0)."""
    room, out, cells, p, places = max(budget - history - system, 1), [], {}, 0, []
    for i, n in enumerate(sizes):
        is_system = i == 0 and system > 0
        places.append(p)
        cells.setdefault(p // room, []).append(i)
        p += 0 if is_system else n
    places.append(p)
    for cell in cells.values():
        size = places[cell[-1] + 1] - places[cell[0]]
        parts = [cell[:-1], cell[-1:]] if size > room and places[cell[-1]] > places[cell[0]] else [cell]
        for own in parts:
            back = min(history, budget - system - (places[own[-1] + 1] - places[own[0]]))
            again = [i for i in range(own[0]) if (i == 0 and system > 0) or (back > 0 and places[i] >= places[own[0]] - back and not (i == 0 and system > 0))]
            out.append((again, own))
    return out


CASES = {
    "long system": (300, [100] * 12), "no system": (0, [100] * 12), "short turns": (10, [1] * 400), "one very long": (40, [3, 2000, 5, 5, 600, 1]), "system over the budget": (900, [10, 20, 30]),
    "uneven": (60, [7, 90, 200, 13, 380, 44, 4, 4, 130, 129, 500, 1, 2, 3]), "system alone": (5, []), "system to the brim": (380, [1, 2, 3, 124, 125, 126])}


@pytest.mark.parametrize("name", CASES)
def test_windows_keep_their_budget(spark, name):
    system, turns = CASES[name]
    texts = ([("system", says(system))] if system else []) + [(("user", "assistant")[i % 2], says(n)) for i, n in enumerate(turns)]
    rows = [(1, i, r, f"{i} {t}"[: len(t)] if t else "") for i, (r, t) in enumerate(texts)]
    sizes = [len(t.split()) + chat.TURN_WORDS for _, _, _, t in rows]
    got = chat.format_windows(spark.createDataFrame(rows, DDL), 512, 128, block=5, spread=3).orderBy("window").collect()
    want = plain_windows(sizes, sizes[0] if system else 0, 512, 128)
    assert [(r.n_context, r.n_turns) for r in got] == [(len(a), len(o)) for a, o in want]
    for r, (again, own) in zip(got, want, strict=True):
        held = [rows[i] for i in [*again, *own]]
        assert r.formatted == "".join(f"{chat.START}{role}\n{text}{chat.END}\n" for _, _, role, text in held)
        whole = sum(sizes[i] for i in [*again, *own])
        assert whole <= 512 or [i for i in again if not (i == 0 and system)] == [] and len(own) - (0 in own and bool(system)) == 1
        assert [r.formatted[s.start : s.start + s.len] for s in r.loss_spans] == [rows[i][3] for i in own if rows[i][2] == "assistant"]
        assert not system or 0 in again or 0 in own


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", says(70_000)), (2, 0, "system", "s"), (2, 0, "system", "s"), (None, 1, None, None), (None, 1, "assistant", "x")]
    odd = spark.createDataFrame(rows, DDL).withColumns({c: F.lit(7) for c in ("window", "_i", "formatted", "again", "_c")})
    got = {(r.conv_id, r.window): r for r in chat.format_windows(odd).collect()}
    assert sum(r.n_turns for r in got.values()) == len(rows)
    assert sum(r.n_turns for k, r in got.items() if k[0] is None) == 2
    back = chat.read_windows(chat.format_windows(odd)).where("conv_id = 1").orderBy("window").collect()
    assert [(t.role, t.text) for r in back for t in r.turns] == [("assistant", says(70_000)), ("user", "a"), ("user", "a")]
    assert chat.format_windows(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.format_windows(odd, 100, 100)
