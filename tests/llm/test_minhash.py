import random

import numpy as np
import pyarrow as pa
import pytest

from tallywright.llm import kernels as K
from tallywright.llm import minhash
from tallywright.llm.components import components

from .cases import DOC_SCHEMA, DOCS, documents, shingles


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def test_cases(spark):
    got = minhash.near_duplicates(documents(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1]) for r in DOCS])


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_chains_and_unlike_groups(spark):
    draw = random.Random(3)
    rows, i = [], 0
    for _ in range(6):  # chains of small edits, whose ends are unlike
        words = [f"w{draw.randrange(900)}" for _ in range(80)]
        for _ in range(12):
            rows.append((i, " ".join(words), "en", "s", 1))
            words[draw.randrange(80)] = f"w{draw.randrange(900)}"
            i += 1
    shared = [f"s{j}" for j in range(60)]
    for _ in range(40):  # a long passage that many share, which is not enough
        rows.append((i, " ".join(shared + [f"u{draw.randrange(10**6)}" for _ in range(25)]), "en", "s", 1))
        i += 1
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1]) for r in rows])


def test_second_round_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    test_chains_and_unlike_groups(spark)


@pytest.mark.parametrize("most", [10, 1 << 20])
def test_kernel_words(most):
    texts = [r[1] for r in DOCS] + ["a\x0bb\x1cc", "\n\nx  y\n"]
    sizes, distinct = [], {}
    for c in K.chunks(pa.array(texts, pa.string()), most):
        h, doc = K.word_hashes(c)
        sizes += np.bincount(doc, minlength=c.n).tolist()
        s, d = K.distinct_sorted(*K.shingle_hashes(h, doc))
        for i in range(c.n):
            distinct[c.first_row + i] = frozenset(s[d == i].tolist())
    import re

    assert sizes == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [len(distinct[i]) for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(distinct[i] & distinct[j]) == len(shingles(a) & shingles(b))


def test_components(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_sketch_likeness():
    probes = K.probe_table(512)
    draw = np.random.Generator(np.random.PCG64(5))
    for common, own in ((30, 10), (3, 1), (600, 100), (5, 40)):
        both = draw.integers(0, 1 << 63, common).astype(np.uint64) * np.uint64(2)
        a, b = (np.concatenate((both, draw.integers(0, 1 << 63, own).astype(np.uint64) * np.uint64(2))) for _ in range(2))
        h, d = K.distinct_sorted(np.concatenate((a, b)), np.repeat([0, 1], common + own))
        sketch = K.one_permutation(h, d, 2, 512, probes)
        true = common / (common + 2 * own)
        assert abs((sketch[0] == sketch[1]).mean() - true) < 0.12


def test_repeated_ids_link_by_any_text(spark):
    """Document 9 repeats document 1's text, and its other text is near document 7's."""
    one, other = " ".join(f"a{i}" for i in range(60)), [f"b{i}" for i in range(60)]
    rows = [(1, one), (9, one), (9, " ".join(other)), (7, " ".join([*other[:-1], "c"])), (3, "unlike the rest of them all")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (9, 1), (7, 1), (3, 3)} and len(got) == 5


def exact_components(rows, percent=75):
    """Components by an exact prefix-filter join: sets this alike share one of their rarest shingles."""
    sets = {i: shingles(t) for i, t in rows}
    often = {}
    for s in sets.values():
        for x in s:
            often[x] = often.get(x, 0) + 1
    root, index = {i: i for i in sets}, {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sorted(sets.items()):
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in rare for j in index.get(x, ())}:
            t = sets[j]
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in rare:
            index.setdefault(x, []).append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_whole_table_is_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want = exact_components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert len({c for _, c in want.values()}) < len(want) and got == want


def test_beyond_the_broadcast_bounds(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_COPIED", -1)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)
    test_cases(spark)
    test_repeated_ids_link_by_any_text(spark)
