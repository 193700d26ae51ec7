"""Turn lanes: 'left;through|right' to packed numbers and back, and questions about them.

A lane is one number: bit 0 active, its first turn from bit 1, second from bit 5, third from bit 10.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: turn numbers and their letters
CODES = {"C": 1, "TL": 2, "TSLL": 3, "TSHL": 4, "TR": 5, "TSLR": 6, "TSHR": 7, "KL": 8, "KR": 9, "TU": 10, "TRU": 11, "OFFR": 12, "RNDB": 13, "RNLB": 14}
NAMES = {v: k for k, v in CODES.items()}
# fixed values: lane words
WORDS = {"": "C", "none": "C", "through": "C", "slight_left": "TSLL", "slight_right": "TSLR", "left": "TL", "right": "TR", "sharp_left": "TSHL", "sharp_right": "TSHR", "reverse": "TU", "merge_to_left": "C", "merge_to_right": "C"}
LEFT_TO_RIGHT = ("TU", "TSHL", "TL", "TSLL", "KL", "C", "KR", "TSLR", "TR", "TSHR", "TRU")
_AT = (1, 5, 10)
_BITS = (4, 5, 5)


def turns_of(lane: int) -> list[int]:
    return [t for t in ((lane >> a) & ((1 << b) - 1) for a, b in zip(_AT, _BITS)) if t]


def packed(turns: list[int], active: bool = False) -> int:
    return sum(t << a for t, a in zip(turns, _AT)) | active


def parse_lanes(text: str | None, main: int = 0) -> list[int] | None:
    """Packed lanes; the main turn, where a lane has it, comes first in it. Unknown words count as straight on."""
    if text is None:
        return None
    out = []
    for lane in text.split("|"):
        turns: list[int] = []
        for w in lane.split(";"):
            t = CODES[WORDS.get(w.strip(), "C")]
            if t not in turns:
                turns.append(t)
        if main in turns:
            turns.remove(main)
            turns.insert(0, main)
        out.append(packed(turns[:3]))
    return out


def lanes_column(text: Column, main: int = 0) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda v: parse_lanes(v, main)) if len(s) else pd.Series([], dtype=object), "array<int>")(text)


def shown(lanes: Column) -> Column:
    """'+TL,C|TR': active lanes with a plus, turns by commas, lanes by bars."""
    name = F.create_map(*[F.lit(x) for kv in sorted(NAMES.items()) for x in kv])

    def lane(v: Column) -> Column:
        turns = F.filter(F.array(*[F.shiftright(v, a).bitwiseAND((1 << b) - 1) for a, b in zip(_AT, _BITS)]), lambda t: t > 0)
        return F.concat(F.when(v.bitwiseAND(1) == 1, "+").otherwise(""), F.array_join(F.transform(turns, lambda t: name[t]), ","))

    return F.array_join(F.transform(lanes, lane), "|")


def read(text: str) -> list[int]:
    """shown() undone."""
    return [packed([CODES[t] for t in lane.lstrip("+").split(",") if t], lane.startswith("+")) for lane in text.split("|")]


def distinct_turns(lanes: Column) -> Column:
    """All turns of all lanes, each once, in order of first place."""
    each = F.transform(lanes, lambda v: F.array(*[F.shiftright(v, a).bitwiseAND((1 << b) - 1) for a, b in zip(_AT, _BITS)]))
    return F.array_distinct(F.filter(F.flatten(each), lambda t: t > 0))


def left_to_right(turns: Column) -> Column:
    """Turn numbers in the order they lie from left to right; others last."""
    place = F.create_map(*[F.lit(x) for i, n in enumerate(LEFT_TO_RIGHT) for x in (CODES[n], i)])
    key = lambda t: F.coalesce(place[t], F.lit(99)) * 100 + t
    return F.transform(F.array_sort(F.transform(turns, key)), lambda k: k % 100)


def has_turn(lanes: Column, turn: str) -> Column:
    return F.array_contains(distinct_turns(lanes), CODES[turn])


def activate(lanes: list[int], turn: int) -> list[int]:
    """Lanes that allow a turn become active with that turn first; the others are not active."""
    out = []
    for v in lanes:
        t = turns_of(v)
        if turn in t:
            t.remove(turn)
            out.append(packed([turn, *t], True))
        else:
            out.append(v & ~1)
    return out


def active_range(lanes: list[int], turn_side: int, n_left: int, n_right: int) -> tuple[int, int]:
    """First and last lane that stay on a path when n_left lanes leave to the left and n_right to the right; (-1, -1) if none does."""
    lo, hi = n_left, len(lanes) - n_right - 1
    return (lo, hi) if 0 <= lo <= hi else (-1, -1)


DESCRIPTIONS = {
    "C": "Go ahead", "TL": "Turn left", "TSLL": "Turn slightly left", "TSHL": "Turn sharply left", "TR": "Turn right", "TSLR": "Turn slightly right", "TSHR": "Turn sharply right",
    "KL": "Keep left", "KR": "Keep right", "TU": "Make uturn", "TRU": "Make uturn", "OFFR": "Off route",
}


def description(turn: Column, exit_: Column) -> Column:
    """What to say of a turn name; a roundabout (RNDB...) names its exit."""
    out = F.when(turn.startswith("RN"), F.concat(F.lit("Take "), exit_.cast("string"), F.lit(" exit")))
    for k, v in DESCRIPTIONS.items():
        out = out.when(turn == k, v)
    return out.otherwise("")


def parse_turn(turn: Column) -> dict[str, Column]:
    """A turn name with its exit number: 'RNDB3' is (RNDB, 3), 'TL' is (TL, 0)."""
    return {"turn": F.regexp_extract(turn, "^([A-Z]+)", 1), "exit": F.coalesce(F.regexp_extract(turn, "([0-9]+)$", 1).try_cast("int"), F.lit(0))}
