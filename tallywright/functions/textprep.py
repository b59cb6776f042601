"""Survey text: privacy masking, normalising, tokens and stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A payment card is 13 to 19 digits with single blanks or hyphens between them that pass Luhn's check.
CARD = r"(?<![\d#])\d(?:[\s-]?\d){12,18}(?!\d)"
_GAP = r"[\s.-]?"
_MOBILE = rf"(?:9\d\d|8[1-9]\d)"
# Masks in the order in which they apply; patterns are Java's and Python's alike. A number after "#" is an order, not a phone.
MASKS = (
    # national identity: 12 or 16 digits in fours with hyphens anywhere, with blanks shortly after its name
    ("$1[ID]", r"(?i)(\b(?:phil\s?sys|phil\s?id|national\s+id|psn|pcn)\b[^\d\n]{0,30})\d{4}[\s-]?\d{4}[\s-]?\d{4}(?:[\s-]?\d{4})?(?!\d)"),
    ("[ID]", r"(?<![\d#])\d{4}(?:-\d{4}){2,3}(?![\d-])"),
    # mobile phones, then land lines with an area code, then the eight digits of the capital
    ("[PHONE]", rf"(?<!\d)(?:\+?63{_GAP}\(?{_MOBILE}\)?|\(?0{_MOBILE}\)?){_GAP}(?:\d{_GAP}){{6}}\d(?!\d)"),
    ("[PHONE]", rf"(?<![\d#])(?:\(0\d{{1,2}}\)|0\d{{1,2}}|\+63{_GAP}\(?\d{{1,2}}\)?){_GAP}\d{{3,4}}{_GAP}\d{{4}}(?!\d)"),
    ("[PHONE]", r"(?<![\d#.,-])8(?:\d{3}-|[\s.-]\d{3}[\s.-])\d{4}(?![\d-])"),
    ("[EMAIL]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    # tax, social security, health insurance and unified numbers, by their groups of digits
    ("[ID]", r"(?<![\d-])\d{3}[\s-]\d{3}[\s-]\d{3}(?:[\s-]\d{3,5})?(?![\d-])"),
    ("[ID]", r"(?<![\d-])\d{2}[\s-]\d{7}[\s-]\d(?![\d-])"),
    ("[ID]", r"(?<![\d-])\d{2}[\s-]\d{9}[\s-]\d(?![\d-])"),
    ("[ID]", r"(?<![\d-])\d{4}[\s-]\d{7}[\s-]\d(?![\d-])"),
    ("$1[ID]", r"(?i)(\b(?:umid|crn)[\s:.#-]*)\d{4}-?\d{7}-?\d\b"),
)
#: Words before a capitalised name, and markers that a name in small letters may follow too, as fixed values.
HONORIFICS = tuple(
    "mr mrs ms dr doc sir ma'am mam atty attorney engr gng bb kagawad kapitan mayor kuya ate tita tito mang aling manang manong lolo lola ninong ninang".split()
)
NAME_MARKERS = ("si", "ni", "kay")
#: Words that are no names though they may stand there: kin and trades, pronouns and particles, what follows "kay" in exclamations.
NOT_NAMES = frozenset(
    "mama papa nanay tatay inay itay nanang tatang lola lolo tita tito kuya ate ninang ninong bunso anak asawa misis mister amo boss kapitbahay kaibigan pinsan pamangkin apo "
    "guard driver rider seller cashier tindera tindero manager doctor doktor nurse teacher titser kapitan kagawad mayor konsehal staff agent crew waiter delivery customer client admin sir ma'am maam madam "
    "ako ikaw siya sila kami tayo kayo niya nila namin natin ninyo kanila akin minsan isa lahat kahit man pa naman talaga rin din lang nga ba daw raw ang ng sa mga na yung iyong po the our your god lord diyos jesus "
    "ganda bilis sarap galing dami init lamig bait sipag tagal hirap saya lungkot laki liit mura lakas husay tamis alat pait asim bango baho linis dumi "
    "gulo ingay tahimik dilim liwanag haba ikli layo lapit bigat gaan taas baba dali swerte malas lambot tigas kapal nipis presko sulit arte kulit tamad".split()
)
#: Words at which a run of names ends.
AFTER_NAMES = frozenset("ang na ay ko mo ka po opo ng sa para kanina kahapon dahil pero kasi at yung mga ug ra jud man mahal ayos masyado sobra hindi wala may meron and or was is the".split())
_CAPITAL = r"(?:[A-ZÑ][a-zñ'-]+|[A-ZÑ]{2,})"
_HONORIFIC = re.compile(rf"\b((?i:{'|'.join(map(re.escape, HONORIFICS))})\b\.?)\s+({_CAPITAL}(?:\s+(?:(?:de|del|dela|de\s+los|de\s+la|la|los|san)\s+)?{_CAPITAL}){{0,2}})")
_MARKED = re.compile(rf"\b((?i:{'|'.join(NAME_MARKERS)}))\s+((?:[A-Za-zÑñ][\w'-]*)(?:\s+[A-Za-zÑñ][\w'-]*){{0,3}})")


def masked_numbers(c: Column) -> Column:
    """Cards (by Luhn), identity and phone numbers and addresses masked, all in built-in expressions."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({CARD})"), 1))
    cards = F.filter(found, lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[ -]", "")))
    text = F.aggregate(cards, text, lambda t, m: F.replace(t, m, F.lit("[CARD]")))
    for mask, pattern in MASKS:
        text = F.regexp_replace(text, pattern, F.lit(mask))
    return text


def mask_names(text: str, allowed: frozenset[str] = frozenset()) -> str:
    """Names after honorifics and name markers; words that are no names and allowed names and brands stay.

    ``allowed`` holds lower-case words, or pairs of words, that may stand as a whole.
    """

    def known(words: list[str]) -> bool:
        return any(w in allowed for w in words) or any(" ".join(p) in allowed for p in zip(words, words[1:]))

    def titled(m: re.Match) -> str:
        words = [w.lower() for w in m[2].split()]
        if words[0] in NOT_NAMES or known([m[1].lower().rstrip("."), *words]):
            return m[0]
        return f"{m[1]} [NAME]" + _rest(m[2], words)

    def marked(m: re.Match) -> str:
        words = [w.lower() for w in m[2].split()]
        if words[0] in NOT_NAMES or words[0] in AFTER_NAMES or len(words[0]) < 3 or known(words):
            return m[0]
        return f"{m[1]} [NAME]" + _rest(m[2], words)

    return _MARKED.sub(marked, _HONORIFIC.sub(titled, text))


def _rest(text: str, words: list[str]) -> str:
    """What follows the name in ``text``: a name in capitals goes on in capitals, any name ends at a common word."""
    parts = re.findall(r"\S+|\s+", text)
    n = 1
    while n < len(words) and words[n] not in NOT_NAMES and words[n] not in AFTER_NAMES and n < 3:
        if parts[0][:1].isupper() and not parts[2 * n][:1].isupper() and words[n] not in ("de", "del", "dela", "la", "los", "san"):
            break
        n += 1
    return "".join(parts[2 * n - 1 :])


def scrub_pii(c: Column, allowed: Iterable[str] = ()) -> Column:
    """All masks; null becomes empty. Applying it twice changes nothing more."""
    keep = frozenset(a.lower() for a in allowed)

    @F.pandas_udf("string")
    def names(s: pd.Series) -> pd.Series:
        return s.map(lambda t: mask_names(t, keep))

    return names(masked_numbers(c))


TOKEN = r"\[[a-z_]+\]|[a-zñ0-9]+(?:[-'][a-zñ0-9]+)*"


def normalise(text: str) -> str:
    """NFKC, lower case, accents off but for the tilde of n, letters of three or more in a row once."""
    t = unicodedata.normalize("NFKC", text).lower().replace("ñ", "\0")
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).replace("\0", "ñ")
    return re.sub(r"([a-z])\1{2,}", r"\1", t)


def normalised(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: normalise(t or ""))

    return run(c)


#: Text-speak, regional particles and common misspellings of answers, and what they stand for, as fixed values.
SPEAK = {
    "diko": "hindi ko", "dko": "hindi ko", "hnd": "hindi", "hndi": "hindi", "di": "hindi", "aq": "ako", "ikw": "ikaw", "sya": "siya", "sta": "siya", "nla": "nila", "nmin": "namin", "kin": "akin",
    "kc": "kasi", "kse": "kasi", "kase": "kasi", "lng": "lang", "ngalang": "nga lang", "den": "din", "dn": "din", "pa dn": "pa din", "pdeng": "pwedeng", "pde": "pwede", "pwde": "pwede",
    "bkt": "bakit", "bkit": "bakit", "tlga": "talaga", "tlaga": "talaga", "sb": "sabi", "dto": "dito", "dun": "doon", "bka": "baka", "brgy": "barangay",
    "ra gyod": "lang talaga", "ra gyud": "lang talaga", "man gud": "kasi nga", "jud": "talaga", "gyud": "talaga",
    "calgate": "colgate", "soff": "sof & mmmm", "planggana": "palanggana", "mbango": "mabango",
}


def respelled(c: Column, speak: dict[str, str] = SPEAK) -> Column:
    """Text with the whole words and phrases of ``speak`` replaced, whatever their case; null becomes empty.

    Longer phrases go first, so "ra gyud" is one phrase. Texts that hold none are not walked again.
    """
    word = lambda w: rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(w)}(?![\p{{L}}\p{{N}}_])"
    text = F.coalesce(c, F.lit(""))
    if not speak:
        return text
    out = text
    for w in sorted(speak, key=lambda w: (-len(w.split()), w)):
        out = F.regexp_replace(out, F.lit(word(w)), F.lit(speak[w].replace("\\", r"\\").replace("$", r"\$")))
    some = "|".join(re.escape(w) for w in speak)
    return F.when(text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{some})(?![\p{{L}}\p{{N}}_])"), out).otherwise(text)


def tokens(c: Column) -> Column:
    """Tokens of normalised text."""
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1)


def expanded(c: Column, speak: dict[str, str]) -> Column:
    """Token array with text-speak replaced; a replacement may be several words."""
    if not speak:
        return c
    table = F.create_map(*[x for k, v in speak.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))])
    return F.flatten(F.transform(c, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))


#: Affixes of Tagalog words, as fixed values.
PREFIXES = ("nakaka", "nakapag", "nakipag", "makapag", "makaka", "napaka", "pinaka", "pagka", "nagpa", "magpa", "ipinag", "ipag", "naka", "maka", "nag", "mag", "pag", "nang", "mang", "pang", "ika", "ipa", "ma", "na", "pa", "ka", "in", "um", "i")
SUFFIXES = ("han", "hin", "nan", "nin", "an", "in")
INFIXES = ("um", "in")
VOWELS = "aeiou"
#: A longer run of letters is no word; it is its own only form.
LONGEST_WORD = 30
#: What a nasal after ma-, na- or pa- may stand for: it takes the place of the root's first consonant.
NASALS = (("ng", ("k", "")), ("m", ("p", "b")), ("n", ("t", "d", "s")))
#: Words that look derived and are not, or mean something else than their root.
NO_STEM = frozenset(
    "kasama kasi kaya kahit kapag kaso kailan kailangan kapatid kapwa kaibigan kapitbahay kalsada kalaban katawan karapatan kalidad mga may mayroon marami maraming mahalaga "
    "masyado matanda magulang na nasa naman namin natin nila niya ninyo ngayon noon nalang pa pala palagi para paano pagkain pagkatapos pamilya pero "
    "hindi huwag wala walang ito iyan iyon isa iba ilan ibang ikaw unang bago bawat kung tungkol talaga talagang habang salamat lahat lagi lang siya sila".split()
)


def _nasal(w: str) -> list[str]:
    """Roots of a word in ma-, na- or pa- whose first consonant a nasal has replaced: mamili from bili, panulat from sulat."""
    new = []
    if w[:2] in ("ma", "na", "pa"):
        for nasal, initials in NASALS:
            rest = w[2 + len(nasal) :]
            if w.startswith(nasal, 2) and rest[:1] and rest[0] in VOWELS:
                if len(rest) > 3 and rest[1:].startswith(nasal + rest[0]):
                    new += [x + rest[1 + len(nasal) :] for x in initials]  # mamimili
                new += [x + rest for x in initials]
    return [f for f in new if len(f) >= 3]


def _unsuffixed(w: str, suffix: str) -> list[str]:
    """Roots of a word without its suffix: as it stands, with o for its last u, and with a vowel that the suffix took."""
    r = w[: -len(suffix)]
    i = r.rfind("u")
    new = [r] + ([r[:i] + "o" + r[i + 1 :]] if i >= max(0, len(r) - 3) else [])
    if r[-1] not in VOWELS and suffix[0] == "h":
        new += [r + v for v in "aiou"]  # dalhin
    elif r[-1] not in VOWELS and r[-2] not in VOWELS:
        new += [r[:-1] + v + r[-1] for v in "aiou"]  # bigyan, sundin
    return new


def candidates(word: str) -> list[str]:
    """Forms that a word may be derived from: affixes, infixes, repeated syllables and linkers taken off, sounds that they changed restored."""
    forms, todo = {word}, [word] if len(word) <= LONGEST_WORD else []
    while todo:  # every step shortens a form
        w = todo.pop()
        new = [w[len(p) :].lstrip("-") for p in PREFIXES if w.startswith(p) and len(w) - len(p) >= 3]
        new += _nasal(w)
        new += [f for s in SUFFIXES if w.endswith(s) and len(w) - len(s) >= 3 for f in _unsuffixed(w, s)]
        new += [w[0] + w[3:] for x in INFIXES if w[1:3] == x and len(w) >= 6 and w[0] not in VOWELS]
        if w.startswith("ni") and w[2:3] in ("l", "y") and len(w) >= 6:
            new.append(w[2:])
        if len(w) > 5 and w[:2] == w[2:4]:
            new.append(w[2:])
        if len(w) > 4 and w[0] in VOWELS and w[0] == w[1:2]:
            new.append(w[1:])
        if w.endswith("ng") and len(w) > 4 and w[-3] in VOWELS:
            new.append(w[:-2])
        if w.endswith("g") and len(w) > 4 and w[-2] == "n":
            new.append(w[:-1])
        if "-" in w:
            new += [p for p in w.split("-") if len(p) >= 3]
        for f in new:
            if f not in forms:
                forms.add(f)
                todo.append(f)
    return sorted(forms, key=lambda f: (len(f), f))


def stem(word: str, roots: frozenset[str]) -> str:
    """The shortest known root that the word may come from, else the word; roots and NO_STEM are their own stems."""
    if word in roots or word in NO_STEM:
        return word
    return next((f for f in candidates(word) if f in roots), word)


def stem_table(df: DataFrame, column: str, roots: Iterable[str]) -> DataFrame:
    """(token, stem) of the distinct tokens in an array column: each word is stemmed once."""
    known = df.sparkSession.sparkContext.broadcast(frozenset(roots))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: stem(t, known.value))

    return df.select(F.explode(column).alias("token")).distinct().withColumn("stem", run("token"))
