"""Small hard tables for the operators' tests."""

DOCS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),
    (3, "The Quick brown fox jumps over the lazy dog near the river bank tonight", "en", "b", 5),
    (3, "The Quick brown fox jumps over the lazy dog near the river bank tonight", "en", "b", 5),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, " \t\n ", "en", None, 4),
    (7, "one two", "en", "c", 7),
    (8, "one two", "fr", "c", 7),
    (9, "one", "fr", "c", 3),
    (10, "word " * 30000 + "end", "de", "b", 150003),
    (11, "x" * 120000, "de", "b", 120000),
    (None, "a text without an id that is long enough for shingles", "de", "b", 10),
    (12, "ÉÉ élan ünï code 😀   text with several words and more", "fr", "d", 10),
    (-5, "negative ids are ids as well and have texts of some words", "fr", "d", 10),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=DOCS):
    """With columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    for name in ("component_id", "kept", "a", "b", "key", "label", "size", "target", "hash", "id", "r", "run", "k", "term", "own", "part", "role", "n_shingles", "score", "length", "slice"):
        df = df.withColumn(name, F.lit(7))
    return df


def shingles(text, k=5):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
