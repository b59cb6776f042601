"""Words and phrases with owners, all looked up in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick


def _wordlike(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


class Triggers:
    """Which owners have one of their triggers in a text, however many triggers there are.

    ``pairs`` are (trigger, owner); case and space around a trigger don't count, and shorter ones than ``least`` are
    left out. With ``whole`` a trigger must begin and end at a word's edge.
    """

    def __init__(self, pairs: Iterable[tuple[str, int]], whole: bool, least: int = 3):
        owners: dict[str, set[int]] = {}
        for trigger, owner in pairs:
            word = str(trigger).strip().lower()
            if len(word) >= least:
                owners.setdefault(word, set()).add(owner)
        self.whole, self.search = whole, ahocorasick.Automaton()
        for word, ids in owners.items():
            self.search.add_word(word, (len(word), frozenset(ids)))
        if owners:
            self.search.make_automaton()

    def owners(self, text: str) -> set[int]:
        """Owners with a trigger in ``text``, which is lower case."""
        found: set[int] = set()
        if not len(self.search):
            return found
        for last, (length, ids) in self.search.iter(text):
            first = last - length + 1
            if self.whole and (_wordlike(text, first - 1) == _wordlike(text, first) or _wordlike(text, last) == _wordlike(text, last + 1)):
                continue
            found |= ids
        return found


def of_topic(topic: dict) -> list[str]:
    """All words and quotes that point to a codeframe's topic."""
    return [w for key in ("keywords", "pos_keywords", "neg_keywords", "exemplars") for w in topic.get(key) or ()]
