"""What a column is called: its name split into words, looked up in lists of words."""

from __future__ import annotations

import re

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_SCALE = re.compile(r"_([0-9]+)to([0-9]+)$")

IDS = frozenset(("id", "ids", "uuid", "no", "respid", "respondentid", "caseid"))
TIMES = frozenset(("duration", "loi", "sec", "secs", "seconds"))
TIME_PAIRS = frozenset((("time", "taken"), ("completion", "time"), ("interview", "length")))
RATINGS = frozenset(("likert", "nps", "rating", "ratings", "sat", "satisfaction", "satisfied", "csat"))
OPEN_ENDS = frozenset(("comment", "comments", "feedback", "open", "other", "openend", "verbatim", "verbatims"))
COUNTS = frozenset(("age", "ages", "size", "count", "counts", "visit", "visits", "kilo", "kilos", "hour", "hours", "duration", "income", "child", "children", "stub"))
CODES = frozenset(("code", "stub"))


def words(name: str) -> list[str]:
    """Lower-case words of a name: at capitals, digits and any other character a word ends."""
    return [w.lower() for w in _WORD.findall(name)]


def is_id(name: str) -> bool:
    """Named like an identifier: by its last word."""
    w = words(name)
    return bool(w) and w[-1] in IDS and (len(w) > 1 or w[-1] != "no")


def is_row_number(name: str) -> bool:
    return words(name) in (["row", "no"], ["rowno"], ["row", "number"])


def is_time(name: str) -> bool:
    """Named like the length of an interview."""
    w = words(name)
    return not TIMES.isdisjoint(w) or not TIME_PAIRS.isdisjoint(zip(w, w[1:]))


def scale_of(name: str) -> tuple[int, int] | None:
    """The bounds in a name that ends like ``_1to5``."""
    found = _SCALE.search(name)
    return (int(found[1]), int(found[2])) if found else None


def is_rating(name: str) -> bool:
    """Named like an answer on a scale."""
    return scale_of(name) is not None or not RATINGS.isdisjoint(words(name))


def is_open_end(name: str) -> bool:
    return not OPEN_ENDS.isdisjoint(words(name))


def is_code(name: str) -> bool:
    w = words(name)
    return len(w) > 1 and w[-1] in CODES


def is_count(name: str) -> bool:
    """Named like a number of things, not like an answer on a scale."""
    return is_id(name) or is_row_number(name) or not COUNTS.isdisjoint(words(name))
