"""Codeframes: loading, checking, and reading them from workbooks and tables."""

from __future__ import annotations

import csv
import io
import json
import os
import re

from tallywright.functions.coding import SPECIAL
from tallywright.sources.workbook import Workbook

MAX_BYTES, MAX_TOPICS, MAX_KEYWORDS = 1 << 20, 500, 2000
NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")
STOPWORDS = frozenset("the a an and or of to in is it for on with was are be this that at by from as not no but so very my i we they ang ng sa na mga at ay ko mo po lang para may".split())
POSITIVE, NEGATIVE = re.compile(r"\b(?:good|great|better|positive|favorable|accomplishments?|satisf\w*|like\w*|love\w*|happy|affordable|maganda|masarap)\b", re.I), re.compile(r"\b(?:bad|poor|worse|negative|unfavorable|concerns?|problems?|deficit|dissatisf\w*|dislike\w*|not|no|lack\w*|expensive|slow|panget|mahal)\b", re.I)
HEADERS = {"code": ("code", "codes", "code_id", "id"), "label": ("label", "theme", "description", "name"), "net": ("net", "category", "group"), "subnet": ("subnet", "subcategory"), "quotes": ("quotes", "anchored verbatims", "verbatims", "exemplars", "examples"), "polarity": ("polarity", "sentiment")}


def validated(frame: dict) -> dict:
    """The frame with its special codes filled in; ValueError names what is wrong."""
    if frame.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    topics = frame.get("topics")
    if not isinstance(topics, list) or not topics or len(topics) > MAX_TOPICS:
        raise ValueError(f"a codeframe has 1 to {MAX_TOPICS} topics")
    labels: dict[int, str] = {}
    for t in topics:
        if not t.get("id") or not t.get("codes"):
            raise ValueError("each topic needs an id and codes")
        for key in ("keywords", "pos_keywords", "neg_keywords"):
            words = t.get(key, [])
            if len(words) > MAX_KEYWORDS or not all(isinstance(w, str) and w.strip() for w in words):
                raise ValueError(f"{t['id']}: {key} must be up to {MAX_KEYWORDS} texts")
        for polarity, code in t["codes"].items():
            if polarity not in ("pos", "neg", "neutral") or not isinstance(code.get("code_id"), int):
                raise ValueError(f"{t['id']}: codes are pos, neg or neutral with whole numbers")
            if labels.setdefault(code["code_id"], code.get("label")) != code.get("label"):
                raise ValueError(f"code {code['code_id']} has two labels")
    for word, value in (frame.get("sentiment_overrides") or {}).items():
        if not -3 <= float(value) <= 3:
            raise ValueError(f"override of {word} must lie in -3 to 3")
    return {**frame, "special_codes": {**SPECIAL, **(frame.get("special_codes") or {})}}


def load(name: str, folders: list[str], seen: tuple[str, ...] = ()) -> dict:
    """A codeframe by name from the first folder that has it; included frames' topics come first."""
    if not NAME.fullmatch(name):
        raise ValueError("a codeframe's name has letters, digits, _ and -")
    if name in seen:
        raise ValueError(f"{name} includes itself")
    for folder in folders:
        root, path = os.path.realpath(folder), os.path.realpath(os.path.join(folder, name + ".json"))
        if os.path.dirname(path) == root and os.path.isfile(path):
            if os.path.getsize(path) > MAX_BYTES:
                raise ValueError(f"{name} is larger than {MAX_BYTES} bytes")
            with open(path, encoding="utf-8") as f:
                frame = json.load(f)
            before = [t for i in frame.get("includes") or [] for t in load(i, folders, (*seen, name))["topics"]]
            return validated({**frame, "topics": before + frame.get("topics", [])})
    raise ValueError(f"no codeframe {name}")


def keywords_from(label: str, exemplars: list[str] = ()) -> list[str]:
    """Words and pairs of words of a label and its quotes, without stopwords, sorted, at most 200."""
    found: set[str] = set()
    for text, least in [(label, 3), *((e, 4) for e in exemplars)]:
        words = re.findall(r"[a-zñ0-9'-]+", text.lower())
        found.update(w for w in words if len(w) >= least and w not in STOPWORDS)
        found.update(f"{a} {b}" for a, b in zip(words, words[1:]) if a not in STOPWORDS and b not in STOPWORDS)
    return sorted(found)[:200]


def polarity_of(label: str) -> str:
    return "neg" if NEGATIVE.search(label) else "pos" if POSITIVE.search(label) else "neutral"


def _topic(code: int, label: str, net: str, subnet: str, quotes: list[str], polarity: str | None = None) -> dict:
    return {"id": re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_") or f"code_{code}", "net": net, "subnet": subnet, "codes": {polarity or polarity_of(label): {"code_id": code, "label": label}}, "keywords": keywords_from(label, quotes), "pos_keywords": [], "neg_keywords": [], "exemplars": quotes}


def _frame(topics: list[dict], name: str) -> dict:
    labels: dict[int, str] = {}
    for t in topics:
        for c in t["codes"].values():
            if labels.setdefault(c["code_id"], c["label"]) != c["label"]:
                raise ValueError(f"code {c['code_id']} has two labels: {labels[c['code_id']]} and {c['label']}")
    return validated({"schema_version": 1, "id": name, "name": name, "domain": "custom", "topics": topics})


def _columns(header: list[str]) -> dict[str, int]:
    names = [(h or "").strip().lower() for h in header]
    return {k: next(i for i, n in enumerate(names) if n in syn) for k, syn in HEADERS.items() if any(n in syn for n in names)}


def from_rows(rows: list[list[str | None]], name: str = "custom") -> dict:
    """A table with a header among the first 15 rows. Rows without a whole code are headings.

    A heading's ending tells its level: (NET), (Subnet), (Sub-subnet) and so on; a topic's subnet is the path
    from the second level on, joined by " > ". A heading without such an ending is a net before the first
    code, and a subnet after. Its words also give a polarity to the codes below that tell none, until another
    heading does.
    """
    at = next((i for i, r in enumerate(rows[:15]) if {"label"} <= set(_columns(r)) and len(_columns(r)) >= 2), None)
    if at is None:
        raise ValueError("no header with a code or label column in the first 15 rows")
    col, topics, net, path, lean = _columns(rows[at]), [], "", [], None
    get = lambda r, k: (r[col[k]] or "").strip() if k in col and col[k] < len(r) else ""
    for n, r in enumerate(rows[at + 1 :], 1):
        label, code = get(r, "label"), get(r, "code")
        if not label:
            continue
        if "code" in col and not re.fullmatch(r"\d+(?:\.0)?", code):
            kind = re.search(r"\(((?:sub-?)*)net\)\s*$", label, re.I)
            clean = re.sub(r"\s*\([^)]*\)\s*$", "", label)
            depth = len(re.findall("sub", kind[1], re.I)) if kind else int(bool(topics))
            if depth:
                path = [*path[: depth - 1], clean]
            else:
                net, path = clean, []
            lean = {"neutral": lean}.get(polarity_of(label), polarity_of(label))
            continue
        number = int(float(code)) if code else n + 100
        quotes = [q.strip() for q in re.split(r"[;\n|]", get(r, "quotes")) if q.strip()]
        polarity = {"positive": "pos", "pos": "pos", "negative": "neg", "neg": "neg", "neutral": "neutral"}.get(get(r, "polarity").lower())
        if polarity is None and polarity_of(label) == "neutral":
            polarity = lean
        topics.append(_topic(number, label, get(r, "net") or net or "General", get(r, "subnet") or " > ".join(path) or "General", quotes, polarity))
    return _frame(topics, name)


def from_csv(data: bytes, name: str = "custom") -> dict:
    for codec in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            text = data.decode(codec)
            break
        except UnicodeDecodeError:
            continue
    return from_rows([list(r) for r in csv.reader(io.StringIO(text))], name)


def from_xlsx(data: bytes, name: str = "custom") -> dict:
    book = Workbook(data)
    return from_rows([[v for v, _ in r] for r in book.rows(next(iter(book.sheets)))], name)


def suggested(category: str, frames: dict[str, list[str]]) -> str | None:
    """The frame one of whose words occurs in the category; None asks for a choice."""
    return next((f for f, words in frames.items() if any(w.lower() in category.lower() for w in words)), None)
