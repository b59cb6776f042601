from fractions import Fraction

from tallywright.llm import mixing

from .cases import DOC_SCHEMA, DOCS, documents


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, heavy = total - sum(cap * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        share = {s: Fraction(rest * weight[s], heavy) for s in order if s not in capped}
        over = {s for s, v in share.items() if v > cap * sizes[s]}
        if not over:
            return {s: Fraction(cap * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def test_cases(spark):
    rows = mixing.mix_report(documents(spark)).collect()
    assert len(rows) == len(DOCS)
    sizes = {}
    for d in DOCS:
        sizes[d[3]] = sizes.get(d[3], 0) + len((d[1] or "").split(None)) if d[1] is None or "\x1c" not in d[1] else 0
    want = brute_targets(sizes)
    source = {}
    for d in DOCS:
        source.setdefault(d[0], d[3])
    for r in rows:
        assert abs(r.target - float(want[source[r.doc_id]])) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(documents(spark)).collect()))
    assert mixing.mix_report(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    repeated = mixing.mixed_rows(documents(spark))
    assert repeated.columns == documents(spark).columns
    assert sum(len((r.text or "").split()) for r in repeated.collect()) == sum(r.taken for r in rows)


def test_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1
    want = brute_targets({s: int(g["size"].sum()) for s, g in got.groupby("source")})
    assert all(abs(float(want[s]) - g.target.iloc[0]) < 1e-6 for s, g in got.groupby("source"))


def test_clamping(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 1000, None: 5}, {"a": 1, "b": 0, "c": 0}, {"a": 1, "b": 10**12, "c": 7, "d": 3, "e": 10**6}, {"a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - float(want[s])) <= 1e-9 * max(1.0, float(want[s])) for s in sizes), (sizes, got, want)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    want = sorted(map(str, mixing.mix_report(documents(spark)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CUTS", -1)
    assert sorted(map(str, mixing.mix_report(documents(spark)).collect())) == want
