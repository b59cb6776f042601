import random
import zlib

import numpy as np

from tallywright.llm import quality

from .cases import DOC_SCHEMA, documents


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.scored(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.9 and ((got.predicted == 1) == (got.quality == 1)).mean() > 0.9
    assert ((got.predicted == 1) == (got.score >= 0.3)).all()


def test_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 0), (1, None, 0), (2, 5, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(documents(spark), labels).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    none = labels.limit(0)
    assert len({r.score for r in quality.scored(documents(spark), none).collect()}) == 1
    assert quality.scored(spark.createDataFrame([], DOC_SCHEMA), labels).collect() == []
    assert quality.accepted(documents(spark), labels).columns == documents(spark).columns


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    one, two = (sorted(map(tuple, quality.scored(docs, x).collect())) for x in (labels, flipped))
    assert one == two


def test_column_equals_model(spark):
    draw = np.random.Generator(np.random.PCG64(1))
    x = draw.random((300, len(quality.STATISTICS)))
    model = quality.fit(x, (x[:, 3] + x[:, 5] > 1).astype(float))
    df = spark.createDataFrame(x.tolist(), list(quality.STATISTICS))
    assert model.rules and np.allclose([r.s for r in df.select(model.column().alias("s")).collect()], model.score(x))


def test_statistics_are_finite():
    import pyarrow as pa

    from tallywright.llm import kernels as K

    texts = ["", "a", "\n", "\n\n a\n", "A B C", "é 😀 1!!", " ", "x" * 5000, "a b\na b\nc"]
    (c,) = K.chunks(pa.array(texts))
    s = quality.chunk_statistics(c)
    assert np.isfinite(s).all()
    at = {n: i for i, n in enumerate(quality.STATISTICS)}
    assert s[4, at["upper_share"]] == 1 and s[5, at["digit_words"]] == 1 / 3 and s[8, at["distinct_lines"]] == 2 / 3
    draw = random.Random(1)
    many = ["".join(draw.choice("ab \n!1É") for _ in range(draw.randrange(30))) for _ in range(500)]
    (c,) = K.chunks(pa.array(many))
    s = quality.chunk_statistics(c)
    for t, row in zip(many, s):
        lines = t.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert np.isclose(row[at["distinct_lines"]], len(set(lines)) / len(lines) if lines else 0), repr(t)
        assert np.isclose(row[at["log_chars"]], np.log1p(len(t)))
