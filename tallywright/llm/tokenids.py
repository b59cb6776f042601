"""Token ids of whole texts, each distinct run of characters encoded once.

The tokenizer (``word_bpe``) drops white space, folds case and cuts texts into runs of letters, of
digits and of other characters before it merges within a run, so a text's ids are those of its runs one
after another. Runs are found and hashed with numpy over a chunk of texts; only runs not seen before in
this process go through the tokenizer, many at a time.

A run is cut from a word only where that is certain: inside words of ASCII and Latin letters without an
apostrophe before a letter. Any other word is encoded whole.
"""

from __future__ import annotations

import numpy as np

from tallywright.llm import kernels as K

SPACE_, LETTER, DIGIT, OTHER, ODD = range(5)
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[33:127] = OTHER
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE_
#: Runs that are remembered, about 50 bytes each; beyond it the memory starts anew.
REMEMBERED = 300_000


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; letters up to U+017F count as such, with both their bytes."""
    out = _CLASS[data]
    if (data > 127).any():
        lead = (data >= 0xC3) & (data <= 0xC5)
        second = np.zeros(len(data), bool)
        second[1:] = lead[:-1]
        latin = lead | second
        out[latin] = LETTER
        before = np.zeros(len(data), np.uint8)
        before[1:] = data[:-1]
        out[second & (((before == 0xC3) & ((data == 0x97) | (data == 0xB7))) | ((before == 0xC4) & (data == 0xB0)))] = ODD
    return out


def _folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    out = K.LOWER[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[capital] += 32
    return out


def runs(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run, its text's number, and whether it is a whole odd word."""
    starts, ends, doc = K.word_spans(c)
    if not len(starts):
        return starts, ends, doc, np.zeros(0, bool)
    kind = _classes(c.data)
    odd = kind == ODD
    odd[:-1] |= ((c.data[:-1] == 0x27) & (kind[1:] == LETTER)) | ((c.data[:-1] == 0x3C) & (c.data[1:] == 0x7C))
    total = np.concatenate(([0], np.cumsum(odd)))
    odd_word = total[ends] > total[starts]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    word = np.searchsorted(starts, change, side="right") - 1
    inside = (word >= 0) & (change > starts[word]) & (change < ends[word]) & ~odd_word[word]
    change, word = change[inside], word[inside]
    at = np.concatenate((starts, change))
    of = np.concatenate((np.arange(len(starts)), word))
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    to = np.append(at[1:], 0)
    last = np.append(of[1:] != of[:-1], True)
    return at, np.where(last, ends[of], to), doc[of], odd_word[of]


class Encoder:
    """Ids of texts by remembered runs; ``of`` gives the one of this process."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, tokenizer_path: str) -> Encoder:
        if tokenizer_path not in cls._made:
            cls._made[tokenizer_path] = cls(tokenizer_path)
        return cls._made[tokenizer_path]

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, keys: np.ndarray, words: list[str], odd: np.ndarray) -> None:
        """Encode new words; the tokens that end a run, one for each digit, tell where the next begins."""
        plain = [w for w, o in zip(words, odd) if not o]
        ids = self.encode(" ".join(plain)) if plain else np.zeros(0, np.uint32)
        cut = np.flatnonzero(self.ends[ids]) + 1
        upto = np.cumsum([len(w) if "0" <= w[0] <= "9" else 1 for w in plain], dtype=np.int64)
        if len(plain) and (len(cut) != upto[-1] or cut[-1] != len(ids)):  # not the tokenizer's runs after all
            parts = [self.encode(w) for w in plain]
            ids, cut = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        elif len(plain):
            cut = cut[upto - 1]
        counts, flat = np.zeros(len(words), np.int64), ids
        counts[~odd] = np.diff(cut, prepend=0)
        if odd.any():
            own = iter(np.split(ids, cut[:-1]) if len(plain) else [])
            parts = [self.encode(w) if o else next(own) for w, o in zip(words, odd)]
            counts, flat = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(counts) - counts
        new = len(self.first) + np.arange(len(keys))
        self.first, self.count, self.used = np.concatenate((self.first, starts)), np.concatenate((self.count, counts)), self.used + len(flat)
        at = np.searchsorted(self.keys, keys)  # keys ascend
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, new)

    def chunk(self, c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts one after another, and where each text begins and ends in them."""
        at, to, doc, odd = runs(c)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(c.n + 1, np.int64)
        low = _folded(c.data)
        if odd.any():  # odd words keep their case
            keep = np.zeros(len(c.data) + 1, np.int64)
            np.add.at(keep, at[odd], 1)
            np.add.at(keep, to[odd], -1)
            mask = np.cumsum(keep[:-1]) > 0
            low[mask] = c.data[mask]
        h = K.span_hashes(low, at, to)
        if odd.any():
            h[odd] = K.mix(h[odd] + np.uint64(1))
        unique, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        spot = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        new = self.keys[spot] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            raw = low.tobytes()
            where = one[new]
            self._add(unique[new], [raw[a:b].decode("utf-8") for a, b in zip(at[where].tolist(), to[where].tolist())], odd[where])
            spot = np.searchsorted(self.keys, unique)
        place = self.place[spot][back]
        counts, first = self.count[place], self.first[place]
        total = np.cumsum(counts)
        ids = self.ids[np.repeat(first - (total - counts), counts) + np.arange(total[-1])]
        upto = np.concatenate(([0], total))
        return ids, upto[np.searchsorted(doc, np.arange(c.n + 1))]
