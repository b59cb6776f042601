"""Personal data: exact base patterns, and an information-theoretic sanitiser on top.

The base finds e-mail addresses, IP and card numbers and phone numbers by pattern. The sanitiser asks
which other words give a protected entity away. Entities are the base values found; for a word t in the
documents of an entity e, the corpus gives PMI(e; t) = log2(p(e, t) / (p(e) p(t))), at most the
entity's information content IC(e) = -log2 p(e). A word whose PMI reaches GENERALISE of that content is
replaced by its class wherever it occurs, from REMOVE on it is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import stored
from tallywright.llm.streams import lean

KINDS = ("email", "ip", "card", "phone")
#: Shares of an entity's information content at which a word is generalised or removed.
GENERALISE = 0.8
REMOVE = 0.95
#: Different texts in which a word must accompany an entity.
SUPPORT = 3
#: Revealing words up to this number are sent to every executor (about 8 MB); more are joined by document.
BROADCAST_TERMS = 100_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII punctuation around a word does not belong to it.
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_EDGE_BYTES = _EDGES.encode()
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses; every step is linear, whatever the text."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > end and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            out.append((at, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of each base kind, in order; matches that fail their test are dropped."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def rendered(found: dict[str, list[Span]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found.get(k, ()))


def words(text: str) -> Iterator[tuple[str, int, int]]:
    """Each word without the punctuation around it: folded, start, end."""
    for m in _WORD.finditer(text):
        raw = m[0]
        left = raw.lstrip(_EDGES)
        core = left.rstrip(_EDGES)
        if core:
            at = m.start() + len(raw) - len(left)
            yield core.translate(_FOLD), at, at + len(core)


def byte_words(raw: bytes) -> set[bytes]:
    """The distinct folded words of a text in UTF-8, as ``words`` gives them: bytes split and fold at ASCII only."""
    out = {w.strip(_EDGE_BYTES) for w in set(raw.lower().split())}
    out.discard(b"")
    return out


def cores(text: str) -> set[str]:
    """``byte_words`` of a string."""
    return {w.decode("utf-8", "surrogatepass") for w in byte_words(text.encode("utf-8", "surrogatepass"))}


def _outside(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """The words that overlap no span, by one walk over both in order."""
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, i = [], 0
    for w, a, b in words(text):
        while i < len(merged) and merged[i][1] <= a:
            i += 1
        if i == len(merged) or merged[i][0] >= b:
            out.append((w, a, b))
    return out


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def entity_texts(docs: DataFrame) -> DataFrame:
    """(key, entities, terms) of each document with an entity: a hash of its text, its distinct entities and its other words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text"):
                text = text.as_py()
                spans = sorted((a, b, k) for k, v in base_spans(text).items() for a, b in v)
                if spans:
                    key = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]
                    entities = sorted({f"{k}:{text[a:b].translate(_FOLD)}" for a, b, k in spans})
                    rows.append((key, entities, sorted({w for w, _, _ in _outside(text, spans)})))
            columns = list(zip(*rows)) if rows else [[]] * 3
            types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], ["key", "entities", "terms"])

    return _clean(docs).select("text").mapInArrow(lean(each), "key string, entities array<string>, terms array<string>")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): the number of documents that hold each of the one-column ``terms``, over all documents.

    Up to BROADCAST_TERMS terms are counted within each task and added up; more are joined.
    """
    spark = docs.sparkSession
    if terms.count() <= BROADCAST_TERMS:
        wanted = spark.sparkContext.broadcast(frozenset(r[0].encode() for r in terms.collect()))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter[bytes] = Counter()
            for batch in batches:
                for text in batch.column("text"):
                    found.update(byte_words(text.as_buffer().to_pybytes()) & wanted.value)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "c"])

        return _clean(docs).select("text").mapInArrow(lean(each), "term string, c long").groupBy("term").agg(F.sum("c").alias("n"))
    raw = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    core = F.translate(F.regexp_replace("raw", r"^\p{Punct}+|\p{Punct}+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = _clean(docs).select("text", F.monotonically_increasing_id().alias("k")).select("k", raw.alias("raw")).select("k", core.alias("term"))
    return rows.join(terms.toDF("term"), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n"))


def revealing_terms(docs: DataFrame, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """(term, share): words whose PMI with some entity reaches ``generalise`` of its information content.

    Probabilities are shares of all documents, and a word and an entity meet wherever one text holds both.
    A word counts for an entity if at least ``support`` different texts hold both, so a text and its exact
    copies prove nothing; entities in fewer texts can have no such word and are left out first. A word's
    documents with any entity are some of all its documents, so pairs that fall short even with these are
    left out before the corpus is counted.
    """
    # a text's copies share one row from here on
    texts = entity_texts(docs).groupBy("key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("copies"))
    texts = stored(texts, "entity_texts")
    total = _clean(docs).agg(F.count("*").alias("total"))
    held = texts.select(F.explode("entities").alias("entity"), "terms", "copies")
    per_entity = held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("seen"))
    per_entity = stored(per_entity.filter(F.col("seen") >= support).drop("seen"), "entities")
    several = F.broadcast(per_entity) if per_entity.count() <= BROADCAST_TERMS else per_entity
    here = held.join(several, "entity", "left_semi").select("entity", F.explode("terms").alias("term"), "copies")
    pair = here.groupBy("entity", "term").agg(F.count("*").alias("seen"), F.sum("copies").alias("n_both")).filter(F.col("seen") >= support)
    about = texts.select(F.explode("terms").alias("term"), "copies").groupBy("term").agg(F.sum("copies").alias("n_near"))
    content = F.log2(F.col("total") / F.col("n_entity"))

    def share(n: str) -> Column:
        return F.when(content > 0, F.log2(F.col("n_both") * F.col("total") / (F.col("n_entity") * F.col(n))) / content).otherwise(F.lit(0.0))

    pair = pair.join(per_entity, "entity").join(about, "term").crossJoin(F.broadcast(total))  # one row
    pair = stored(pair.filter(share("n_near") >= generalise), "pairs")
    terms = pair.select("term").distinct()
    if terms.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, share double")
    counted = pair.join(term_counts(docs, terms), "term")
    return counted.select("term", share("n").alias("share")).groupBy("term").agg(F.max("share").alias("share")).filter(F.col("share") >= generalise)


def _class_of(word: str) -> str:
    if any(c.isdigit() for c in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def cleaned(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with its texts sanitised and its other columns unchanged; a null text becomes empty."""
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*(F.col(c) for c in others))
    out = sanitised(docs.withColumn("__rest", rest), generalise, remove, support, keep="__rest")
    return out.select("__rest.*", F.col("clean_text").alias("text"))


def sanitised(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, keep: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its spans and its sanitised text.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, clean_text. Spans are
    kind:start:end in code points, by kind (the base ones, then ``term``) and start. In clean_text base
    spans become [EMAIL] and the like (where they overlap, the one that starts first and is longest
    counts) and terms are generalised or removed. A column named by ``keep`` is passed through. Null texts count as empty. Repeated rows get equal
    results; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    terms = stored(revealing_terms(docs, generalise, support), "terms")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([keep] if keep else []))
    n = terms.count()
    few = n <= BROADCAST_TERMS
    told = spark.sparkContext.broadcast({r.term: r.share for r in terms.collect()} if few else {})
    listed = spark.sparkContext.broadcast(frozenset(w.encode() for w in told.value))
    if few:
        rows = rows.withColumn("own", F.lit(None).cast("map<string,double>"))
    else:
        raw = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
        core = F.translate(F.regexp_replace("raw", r"^\p{Punct}+|\p{Punct}+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        held = rows.select(F.sha2("text", 256).alias("k"), raw.alias("raw")).select("k", core.alias("term")).distinct().join(terms, "term")
        held = held.groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("own"))  # bounded by a text's words
        rows = rows.withColumn("k", F.sha2("text", 256)).join(held, "k", "left").drop("k")
    out_type = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, clean_text string"
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.string()]
    names = [c.split()[0] for c in out_type.split(", ")]
    if keep:
        out_type += f", {keep} {rows.schema[keep].dataType.simpleString()}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("own")):
                text = text.as_py()
                known = told.value if few else dict(own.as_py() or ())
                found = base_spans(text)
                base = rendered(found)
                taken = sorted(((a, b, k) for k, v in found.items() for a, b in v), key=lambda s: (s[0], -s[1]))
                any_known = known and (not few or not listed.value.isdisjoint(byte_words(text.encode())))
                hits = [(a, b) for w, a, b in _outside(text, sorted(taken)) if w in known] if any_known else []
                marks = [(a, b, f"[{k.upper()}]") for a, b, k in taken]
                for a, b in hits:
                    marks.append((a, b, "[REMOVED]" if known[text[a:b].translate(_FOLD)] >= remove else _class_of(text[a:b])))
                parts, end = [], 0
                for a, b, with_ in sorted(marks, key=lambda s: (s[0], -s[1])):
                    if a >= end:
                        parts += [text[end:a], with_]
                        end = b
                    else:
                        end = max(end, b)
                all_spans = rendered({**found, "term": hits}, (*KINDS, "term"))
                out.append((doc, *(len(found[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), all_spans, len(hits), "".join([*parts, text[end:]])))
            columns = list(zip(*out)) if out else [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays + ([batch.column(keep)] if keep else []), names + ([keep] if keep else []))

    return rows.mapInArrow(lean(each), out_type)
