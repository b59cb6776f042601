"""A rule coder in built-in expressions: patterns per code, negation in front, opposite and lumped codes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.textprep import stem

NEGATORS = ("hindi", "di", "wala", "walang", "not", "no", "never", "dili", "don't", "doesn't", "isn't")
#: Negations that are none: "not only", "without equal".
EXCEPTIONS = ("hindi lang", "di lang", "not only", "walang katulad", "walang kapantay")
SPECIAL = {"none": (999, "None"), "reask": (998, "Needs Reask"), "neutral": (900, "General Feedback")}
NONE = r"^(?:none|nothing|wala|n/?a|no comment|wala naman)[\s.!]*$"
REASK = r"^(?:[^\p{L}]*|(\p{L})\1{2,}|asdf\w*|qwer\w*|test+)$"


@dataclass(frozen=True)
class CodeRule:
    """A code, its patterns (words, or regular expressions with a backslash), what it means negated, what it is lumped into."""

    code_id: int
    theme: str
    patterns: tuple[str, ...]
    net: str = ""
    subnet: str = ""
    opposite: int | None = None
    lump_into: int | None = None


@dataclass(frozen=True)
class Sense:
    """A word's second meaning: the code it holds in clauses with one of the cues and none of the words that exclude it."""

    word: str
    code_id: int
    cues: tuple[str, ...]
    unless: tuple[str, ...] = ()


#: "Mahal" is expensive, or loved; a codeframe has its own number for the second.
MAHAL_CUES = (r"\bmahal\s+(?:na\s+mahal|ko|namin|natin|ng\s+customer)\b", "love", "loyal")
MAHAL_UNLESS = ("presyo", "price", "cost", "gastos", "fee", "shipping", "sf", "bayad", "pera", "budget", "piso", "pesos")


def mahal(code_id: int) -> Sense:
    """The sense of "mahal" as love, with its code."""
    return Sense("mahal", code_id, MAHAL_CUES, MAHAL_UNLESS)


def _rooted(c: Column, roots: Iterable[str]) -> Column:
    """Clauses with each word replaced by its root, where it has a known one; negators stay."""
    known = frozenset(r.lower() for r in roots)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda parts: [re.sub(r"[\w'-]+", lambda m: m[0] if m[0] in NEGATORS else stem(m[0], known), p) for p in parts])

    return run(c)


def clauses(c: Column) -> Column:
    """Clauses of a text in lower case, cut at punctuation and contrasting conjunctions."""
    cut = F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)[.!?;,\n]+|\b(?:pero|but|kaso|however)\b")
    return F.filter(F.transform(cut, F.trim), lambda x: x != "")


def _pattern(p: str) -> str:
    return p if "\\" in p else rf"\b{re.escape(p)}\b"


def rule_coded(
    df: DataFrame, column: str, rules: list[CodeRule], lump: bool = False, out: str = "codes", senses: Iterable[Sense] = (), roots: Iterable[str] = ()
) -> DataFrame:
    """``df`` with an array of (code_id, theme, net, subnet), in the order of the rules, each code once.

    A code holds if a clause matches one of its patterns without a negator among the three words before;
    with one, its opposite holds. Answers of nothing, and text without meaning, have special codes, and
    an answer that no rule fits is general feedback. Null and empty answers have no code. Words are of
    letters, marks and digits of any script. With ``roots``, the patterns are also held against the clauses
    with their words stemmed to these. In a clause where a word of ``senses`` stands for its second meaning
    and is not negated, it holds that code and is not read by the rules.
    """
    by_code = {r.code_id: r for r in rules}
    text, parts = F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))), clauses(F.col(column))
    senses, roots = tuple(senses), tuple(roots)
    negator = rf"\b(?:{'|'.join(map(re.escape, NEGATORS))})\b(?:\W+[\w'-]+){{0,2}}\W+"
    excepted = rf"\b(?:{'|'.join(map(re.escape, EXCEPTIONS))})\b"

    def theme(code: int, label: str, net: str, subnet: str) -> Column:
        return F.struct(F.lit(code).alias("code_id"), F.lit(label).alias("theme"), F.lit(net).alias("net"), F.lit(subnet).alias("subnet"))

    def of(code: int) -> Column:
        r = by_code[code]
        to = by_code.get(r.lump_into, r) if lump and r.lump_into else r
        return theme(to.code_id, to.theme, to.net, to.subnet)

    def turned(c: Column, pattern: str) -> Column:
        return c.rlike("(?iU)" + negator + pattern) & ~c.rlike("(?iU)" + excepted)

    any_pattern = lambda patterns: "(?:" + "|".join(_pattern(p) for p in patterns) + ")"

    def second(x: Sense, c: Column) -> Column:
        there = c.rlike("(?iU)" + _pattern(x.word)) & c.rlike("(?iU)" + any_pattern(x.cues)) & ~turned(c, _pattern(x.word))
        return there & ~c.rlike("(?iU)" + any_pattern(x.unless)) if x.unless else there

    def meant(x: Sense) -> Column:
        return F.exists(whole, lambda c: second(x, c))

    def without(c: Column) -> Column:
        for x in senses:
            c = F.when(second(x, c), F.regexp_replace(c, "(?iU)" + _pattern(x.word), " ")).otherwise(c)
        return c

    whole = parts
    parts = F.transform(whole, without) if senses else whole
    pairs = F.zip_with(parts, _rooted(parts, roots) if roots else parts, lambda a, b: F.struct(a.alias("said"), b.alias("rooted")))

    def in_clause(pattern: str, negated: bool) -> Column:
        def test(said: Column, rooted: Column) -> Column:
            either = turned(said, pattern) | turned(rooted, pattern)
            return either if negated else (said.rlike("(?iU)" + pattern) | rooted.rlike("(?iU)" + pattern)) & ~either

        if roots:
            return F.exists(pairs, lambda p: test(p["said"], p["rooted"]))
        return F.exists(parts, lambda c: turned(c, pattern) if negated else c.rlike("(?iU)" + pattern) & ~turned(c, pattern))

    hits = [F.when(meant(x), of(x.code_id)) for x in senses]
    for r in rules:
        any_of = any_pattern(r.patterns)
        hits.append(F.when(in_clause(any_of, False), of(r.code_id)))
        if r.opposite in by_code:
            hits.append(F.when(in_clause(any_of, True), of(r.opposite)))
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    special = lambda k: F.array(theme(*SPECIAL[k], "Special", "Special"))
    lower = F.lower(text)
    codes = (
        F.when(text == "", F.slice(special("neutral"), 1, 0)).when(lower.rlike(NONE), special("none")).when(lower.rlike(REASK), special("reask"))
        .when(F.size(found) > 0, found).otherwise(special("neutral"))
    )
    return df.withColumn(out, codes)
