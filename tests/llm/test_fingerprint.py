import hashlib
import random

import pyarrow as pa

from tallywright.llm import fingerprint as fp

from .cases import DOC_SCHEMA, documents, shingles


def test_cases(spark):
    df = documents(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = sorted(fp.fingerprints(df).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for (_, text), (_, nxt), r in zip(rows, rows[1:] + rows[:1], got):
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == nxt:
            assert r.near_next == 1
        if edited == text:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    by = {}
    for (_, text), r in zip(rows, got):
        assert by.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(by[rows[0][1]]) == fp.BINS * fp.BITS // 4 and by[""] == ""


def test_single_and_empty(spark):
    assert fp.fingerprints(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    (r,) = fp.fingerprints(spark.createDataFrame([(1, "a b c d e f g h i j", "en", "s", 1)], DOC_SCHEMA)).collect()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"a b c d e a b c d e").hexdigest()


def test_likeness_is_unbiased():
    draw = random.Random(2)
    errors = []
    for _ in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(20, 900))]
        other = list(words)
        for _ in range(draw.randrange(len(words))):
            other[draw.randrange(len(words))] = f"x{draw.randrange(5000)}"
        a, b = " ".join(words), " ".join(other)
        v, some = fp.bins_of(pa.array([a, b]))
        s, t = shingles(a), shingles(b)
        errors.append(float(fp.likeness(v[:1], some[:1], v[1:], some[1:])[0]) - len(s & t) / len(s | t))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.2
