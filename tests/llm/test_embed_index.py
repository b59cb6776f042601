import numpy as np
import pytest

from tallywright.llm import embed_index


def brute(rows, cosine=0.95):
    good = [(i, np.array(v, float) / max(abs(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[i] = (len(links[i]), None if i is None else min(seen))
    return out


def test_links(spark, monkeypatch):
    monkeypatch.setattr(embed_index, "BLOCK", 16)
    monkeypatch.setattr(embed_index, "STREAM", 8)
    draw = np.random.Generator(np.random.PCG64(2))
    rows, i = [], 0
    for _ in range(40):
        base = draw.normal(size=32)
        for _ in range(draw.integers(1, 12)):
            rows.append((i, (base + 0.1 * draw.normal(size=32)).tolist()))
            i += 1
    hot = draw.normal(size=32)
    for k in range(120):  # a hot group, some of it exact copies
        rows.append((i, (hot if k % 3 else hot + 0.05 * draw.normal(size=32)).tolist()))
        i += 1
    rows += [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] + [1.0] * 31), (1004, [None] + [1.0] * 31), (1005, [1e300] * 32), (1006, [1.0] * 32), (1007, [2.0] * 16), (1008, [1.0] * 16), (1009, [float("inf")] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as v", "3 as rep", "4 as n_links", "5 as near")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_index.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in embed_index.near_duplicates(df).collect())


def test_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_index.near_duplicates(df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_recall_on_borderline_pairs(spark, monkeypatch, depth):
    """2,400 vectors, 800 pairs with cosines between 0.94 and 0.97: no false link, nearly all true ones."""
    monkeypatch.setattr(embed_index, "ONE_PIVOT", 10**9 if depth == 1 else 0)
    monkeypatch.setattr(embed_index, "TWO_PIVOTS", 0 if depth == 3 else 10**9)
    draw = np.random.Generator(np.random.PCG64(11))
    base = draw.normal(size=(1600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = draw.normal(size=(800, 64))
    other -= (other * base[:800]).sum(1, keepdims=True) * base[:800]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = draw.uniform(0.94, 0.97, 800)[:, None]
    x = np.concatenate((base, cosine * base[:800] + np.sqrt(1 - cosine**2) * other))
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embed_index.near_duplicates(df).collect()
    found = {(r.component_id, r.vec_id) for r in got if not r.kept}
    assert found <= true and len(found) >= 0.98 * len(true) > 400
    assert sum(r.n_links for r in got) == 2 * len(found)  # each link counts once at both ends


def test_empty_and_null_ids(spark):
    assert embed_index.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    rows = embed_index.near_duplicates(spark.createDataFrame([(None, [1.0]), (1, [1.0]), (1, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)], key=str)


def test_links_do_not_depend_on_the_layout(spark, monkeypatch):
    """Lists by one, two or three pivots, in short or long blocks: the same rows, and at least 0.98 of all links."""
    draw = np.random.Generator(np.random.PCG64(12))
    base = draw.normal(size=(1500, 16))
    x = np.concatenate((base, base[:700] + draw.uniform(0.2, 0.35, (700, 1)) * draw.normal(size=(700, 16)), 3 * base[0] + 0.3 * draw.normal(size=(200, 16))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int((x @ x.T >= 0.95).sum()) - len(x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()
    got = []
    for one, two, block in ((10**9, 10**9, 2048), (10**9, 10**9, 24), (0, 10**9, 2048), (0, 0, 2048), (0, 0, 8)):
        monkeypatch.setattr(embed_index, "ONE_PIVOT", one)
        monkeypatch.setattr(embed_index, "TWO_PIVOTS", two)
        monkeypatch.setattr(embed_index, "BLOCK", block)
        got.append(sorted(map(tuple, embed_index.near_duplicates(df).collect())))
    assert all(g == got[0] for g in got)
    assert true >= sum(r[1] for r in got[0]) >= 0.98 * true > 1000


def test_pivots_are_apart(spark):
    """More vectors than pivots on a sphere: linked ones share their nearest pivots all the same."""
    x = np.random.Generator(np.random.PCG64(13)).normal(size=(3000, 3))
    assert len(embed_index._spread(x / np.linalg.norm(x, axis=1, keepdims=True), embed_index.PIVOTS, 0.9)) < 100
    x = x[:400]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(rows)
