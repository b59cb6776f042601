import io
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.functions import coding, textprep
from tallywright.operators import hygiene, multiselect, openends
from tallywright.operators import profile as profiling
from tallywright.plans.catalog import CODEFRAME
from tallywright.sources import codeframes, exports, tables, workbook
from tallywright.streaming import answers


def flags(df, **kw):
    return {r.i: r.flags for r in hygiene.audited(df, **kw).collect()}


def test_hygiene(spark):
    df = spark.createDataFrame([(0, "R1"), (1, " r1"), (2, "R2"), (3, "R3")], "i int, Respondent_ID string")
    assert [i for i, f in flags(df).items() if "DUPLICATE_ID" in f] == [0, 1]
    df = spark.createDataFrame([(0, 4, 4, 4, 4), (1, 4, 5, 4, 4), (2, 3, None, None, None)], "i int, Q1_Rating int, Q2_Rating int, Q3_Rating int, Q4_Rating int")
    assert [i for i, f in flags(df).items() if "STRAIGHT_LINER" in f] == [0]
    df = spark.createDataFrame(list(enumerate([250, 300, 240, 260, 280, 40, 290, None, 0])), "i int, Duration int")
    got = flags(df)
    assert got[5] == ["SPEEDER"] and got[7] == got[8] == ["INVALID_DURATION"] and got[0] == []
    df = spark.createDataFrame([(0, "a", "b", "c", "d"), (1, "a", "b", "c", "d"), (2, "a", "b", "c", "e")], "i int, w string, x string, y string, z string")
    assert [i for i, f in flags(df, id_column="i", substantive=["w", "x", "y", "z"]).items() if f] == [0, 1]
    audited = hygiene.audited(df, id_column="i", substantive=["w", "x", "y", "z"])
    assert hygiene.flag_summary(audited).first().n == 2 and hygiene.quarantined(audited).count() == 3


def test_multiselect(spark):
    answers_ = ["Cash, Card (debit, credit)", "Card (debit, credit), Other: barter", "Cash", None, "Points, vouchers"] * 3
    df = spark.createDataFrame([(a,) for a in answers_], "a string")
    assert dict(multiselect.census(df, "a")) == {"Card (debit, credit)": 6, "Cash": 6, "Points, vouchers": 3}
    got = {r.a: (sorted(r.chosen or []), r.other_text) for r in multiselect.resolved(df, "a").collect()}
    assert got["Card (debit, credit), Other: barter"] == (["Card (debit, credit)"], "barter") and got["Points, vouchers"] == (["Points, vouchers"], None)
    assert got["Cash, Card (debit, credit)"][0] == ["Card (debit, credit)", "Cash"]
    assert multiselect.binary_sets(["QA_MS_Sugg_01_Tables", "QA_MS_Sugg_02_Shade", "Single_Binary_Flag"]) == {"QA_MS_": ["QA_MS_Sugg_01_Tables", "QA_MS_Sugg_02_Shade"]}


def test_profile(spark):
    rows = [(f"R{i}", ["2024-01-02", "2024-02-03"][i % 2], i % 2, 1 + i % 5, ["NCR", "Luzon"][i % 2], 100.5 + i, f"I like number {i} because it is different from {i * 7919} others", None) for i in range(60)]
    df = spark.createDataFrame(rows, "Respondent_ID string, Day string, Flag int, Sat_1to5 int, Region string, Amount double, Open_Feedback string, Nothing string")
    got = {r.column: r.type for r in profiling.profile(df).collect()}
    assert got == {"Respondent_ID": "id", "Day": "datetime", "Flag": "binary", "Sat_1to5": "rating_scale", "Region": "single_select", "Amount": "numeric", "Open_Feedback": "open_ended", "Nothing": "empty"}
    kept = profiling.promoted(spark.createDataFrame([("1", "0001", "2.5"), ("2", "0400", "3")], "id string, Zip string, x string"))
    assert kept.dtypes == [("id", "bigint"), ("Zip", "string"), ("x", "double")]


def test_profile_of_many_values(spark, monkeypatch):
    """Measures against brute force; tasks hold a share of the distinct values, which follows the number of cells."""
    import re
    from collections import Counter

    monkeypatch.setattr(profiling, "CELLS", 300)
    day = ["2024-01-02", "2/3/2024 4:05:06", "-7-8", "a-b-c", None]
    rows = [(f"K{i}", None if i % 7 == 0 else f"w{i % 41} w{i % 3}, x{i}", day[i % 5], float(i % 9), None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t string, d string, x double, nothing string")
    got = {r["column"]: r for r in profiling.measures(df).collect()}
    for i, c in enumerate(df.columns):
        texts = [str(r[i]) for r in rows if r[i] is not None]
        words = Counter(w for s in texts for w in re.findall(r"\w+", s.lower()))
        r = got[c]
        assert r.place == i and (r.n, r.distinct) == (len(texts), len(set(texts)))
        if texts:
            assert r.length == pytest.approx(sum(map(len, texts)) / len(texts)) and r.commas == (c == "t") and r.numeric == (c == "x")
        if c in "ktd":
            assert r.reuse == pytest.approx(sum(n for _, n in words.most_common(30)) / sum(words.values()))
    assert got["d"].dates == pytest.approx(0.5) and (got["x"].low, got["x"].high) == (0.0, 8.0)
    assert got["nothing"].numeric is None and got["nothing"].reuse is None
    assert "Expand" not in profiling.measures(df)._jdf.queryExecution().toString()
    assert profiling._values(df, df.columns).rdd.getNumPartitions() == 1 + 600 * 5 // 300
    assert [(r.n, r.distinct) for r in profiling.measures(df.limit(0)).collect()] == [(0, 0)] * 5


def test_scrubbing(spark):
    texts = ["call 0917 123 4567 or (02) 8123-4567", "card 4111 1111 1111 1111 ok", "order 1234567890123456 of 1,250 pesos", "mail a.b@c.com", "Thanks to Dr. Santos and si Maria", "si ang bait", None, "TIN 123-456-789-000"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    once = df.withColumn("s", textprep.scrub_pii(F.col("t")))
    got = {r.i: r.s for r in once.collect()}
    assert got[0] == "call [PHONE] or [PHONE]" and got[1] == "card [CARD] ok" and got[3] == "mail [EMAIL]"
    assert got[2] == texts[2] and got[4] == "Thanks to Dr. [NAME] and si [NAME]" and got[5] == "si ang bait" and got[6] == "" and got[7] == "TIN [ID]"
    twice = {r.i: r.s2 for r in once.withColumn("s2", textprep.scrub_pii(F.col("s"))).collect()}
    assert twice == got


@given(st.text(alphabet="abgnmpikuot-", min_size=1, max_size=14))
@settings(max_examples=150, deadline=None)
def test_stemming_is_idempotent(word):
    roots = frozenset(["ganda", "linis", "kain", "bait", "tanong", "mahal"])
    s = textprep.stem(word, roots)
    assert textprep.stem(s, roots) == s


def test_stems_and_tokens(spark):
    roots = frozenset(["ganda", "linis", "kain", "bait"])
    assert [textprep.stem(w, roots) for w in ("maganda", "malinis", "kumain", "mabait", "kinain", "xyz")] == ["ganda", "linis", "kain", "bait", "kain", "xyz"]
    assert textprep.normalise("SOOOO GANDÁ Niño") == "so ganda niño"
    df = spark.createDataFrame([("u r [NAME] ok-na",)], "t string").withColumn("k", textprep.expanded(textprep.tokens(textprep.normalised(F.col("t"))), {"u": "you", "r": "are"}))
    assert df.first().k == ["you", "are", "[name]", "ok-na"]
    assert textprep.stem_table(df, "k", roots).count() == 4


def test_coder(spark):
    coder = coding.Coder(CODEFRAME)
    code = lambda t: coder.code(t)
    assert code("the staff is friendly")["sentiment"] == "pos" and code("the staff is not friendly")["sentiment"] == "neg"
    assert code("not expensive")["sentiment"] == "pos" and [t["code_id"] for t in code("not expensive")["themes"]] == [101]
    assert code("not not friendly")["sentiment"] == "pos" and code("hindi mahal")["sentiment"] == "pos"
    mixed = code("the staff is very friendly but it is so expensive")
    assert {(t["topic"], t["polarity"]) for t in mixed["themes"]} == {("service", "pos"), ("price", "neg")}
    assert code("none")["themes"][0]["code_id"] == 999 and code("idk")["themes"][0]["code_id"] == 996 and code("")["needs_review"]
    assert code("qwerty zxcv")["themes"][0]["code_id"] == 995 and coding.Coder(CODEFRAME, review=False).code("qwerty zxcv")["themes"][0]["code_id"] == 900
    df = spark.createDataFrame([(1, "the staff is rude"), (2, None), (3, "cheap price"), (4, "the staff is rude")], "response_id int, t string")
    out = openends.coded(df, "t", CODEFRAME)
    assert {r.response_id: r.coded.sentiment for r in out.collect()} == {1: "neg", 2: "neutral", 3: "pos", 4: "neg"}
    freq = {r.theme: (r.n, r.prevalence, r.quotes) for r in openends.theme_frequencies(out).collect()}
    assert freq["Poor service"] == (2, 50.0, ["the staff is rude"] * 2)
    fix = spark.createDataFrame([("the staff is rude",)], "t string").select(openends.text_key(F.col("t"), "s").alias("text_key"), F.lit("neutral").alias("sentiment"), F.lit(None).cast(f"array<{openends.THEME}>").alias("themes"))
    again = {r.response_id: r.coded.sentiment for r in openends.coded(df, "t", CODEFRAME, feedback=fix, salt="s").collect()}
    assert again == {1: "neutral", 2: "neutral", 3: "pos", 4: "neutral"}
    assert openends.review_queue(out).count() == 1 and {r.sentiment: r.n for r in openends.sentiment_counts(out).collect()} == {"neg": 2, "neutral": 1, "pos": 1}


def test_long_answers_are_linear():
    coder = coding.Coder(CODEFRAME)
    coder.code("not " * 5000)
    coder.code("a" * 50000)


def test_learning(spark):
    draw = random.Random(1)
    rows = [(i, ["good", "fast"] if i % 2 else ["bad", "slow"], "pos" if i % 2 else "neg") for i in range(30)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, label string")
    model = openends.naive_bayes(df, "tokens", "label")
    got = {r.k: r.label for r in openends.naive_bayes_predict(spark.createDataFrame([(1, ["good"]), (2, ["slow", "zzz"])], "k int, tokens array<string>"), "k", "tokens", model).collect()}
    assert got == {1: "pos", 2: "neg"} and openends.naive_bayes(df.limit(5), "tokens", "label") is None
    learner = openends.PassiveAggressive(["pos", "neg"])
    texts = [draw.choice(["nice clean place", "very nice"]) for _ in range(20)] + [draw.choice(["dirty slow place", "so dirty"]) for _ in range(20)]
    learner.update(texts, ["pos"] * 20 + ["neg"] * 20)
    got = learner.apply(spark.createDataFrame([("nice",), ("dirty",)], "t string"), "t").collect()
    assert [r.predicted.label for r in got] == ["pos", "neg"]
    learner.rollback()
    assert not learner.w.any()
    with pytest.raises(ValueError):
        learner.update(["x"] * 501, ["pos"] * 501)


def test_hierarchy(spark):
    rows = [(1, "N", "S1", "a", "x"), (1, "N", "S2", "b", "x"), (2, "N", "S1", "a", "y"), (3, "M", "S3", "c", "y")]
    df = spark.createDataFrame(rows, "r int, net string, sub string, leaf string, g string")
    got = {(r.level, r.net, r.subnet, r.leaf, r.banner): (r.n, round(r.pct, 1)) for r in openends.hierarchy(df, "r", "net", "sub", "leaf", "g").collect()}
    assert got[1, "N", None, None, None] == (2, 66.7) and got[1, "N", None, None, "x"] == (1, 100.0) and got[3, "N", "S1", "a", None] == (2, 66.7)
    assert openends.hierarchy(df, "r", "net", "sub", "leaf").filter("level = 2").count() == 3
    assert b"xl/worksheets/sheet1.xml" in exports.hierarchy_book(openends.hierarchy(df, "r", "net", "sub", "leaf", "g"))


def test_workbooks(spark, tmp_path):
    data = workbook.write([("Cover", [["hello"]]), ("Data", [["id", "Zip", "x"], ["1", "0001", 2.5], ["2", "0400", 3]])])
    (tmp_path / "s.xlsx").write_bytes(data)
    df, meta = tables.read_survey(spark, f"file://{tmp_path}/s.xlsx")
    assert meta["sheet"] == "Data" and df.dtypes == [("id", "bigint"), ("Zip", "string"), ("x", "double")] and df.count() == 2
    rows = [[], ["", "Total", "Male", "Female"], ["Base (unweighted)", "1,075", "(n=500)", "575"], ["", "", "A", "B"], ["Yes", 0.5, 0.6, 0.4], ["", "", "B", ""], ["No", 0.5, 0.4, 0.6]]
    (tmp_path / "b.xlsx").write_bytes(workbook.write([("Table", rows)]))
    t, meta = tables.read_survey(spark, f"file://{tmp_path}/b.xlsx")
    got = {(r.label, r.col_label): r for r in t.collect()}
    assert meta["pretabulated"] and got["Yes", "Total"].base_n == 1075 and got["Yes", "Male"].letters == "B" and got["No", "Female"].value == 0.6 and got["Yes", "Male"].neff is None
    assert [workbook.parse_count(v) for v in ("1,075", "(n=1,075)", "x", None)] == [1075, 1075, None, None]
    assert [workbook.guarded(v) for v in ("=1+1", " @x", "+", "--", "ok", 3)] == ["'=1+1", "' @x", "+", "--", "ok", 3]
    names = workbook.sheet_names(["a/b" * 20, "a/b" * 20])
    assert all(len(n) <= 31 for n in names) and len(set(names)) == 2
    from tallywright.operators import crosstab as ct

    book = exports.banner_book({"Y": ct.crosstab(spark.createDataFrame([("a", "y"), ("b", "n")] * 30, "G string, Y string"), "Y", ["G"])}, ["method"])
    back = workbook.Workbook(book)
    lines = [[v for v, _ in r] for r in back.rows("T1_Y")]
    assert zipfile.is_zipfile(io.BytesIO(book)) and lines[11][0] == "n" and lines[4][1] == "60"
    assert "<script>" not in exports.html_table(spark.createDataFrame([("<script>",)], "t string"), "<x>")


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;q\n1;“smart”\n2;NA\n3;\n".encode("cp1252"))
    df, _ = tables.read_survey(spark, f"file://{tmp_path}/a.csv")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "“smart”"), (2, "NA"), (3, None)]
    with pytest.raises(ValueError):
        tables.read_survey(spark, "x.sav")
    lab = tables.with_value_labels(spark.createDataFrame([(1, 5), (99, 2)], "q int, s_1to5 int"), {"q": {"1": "Yes"}, "s_1to5": {"5": "x"}}, {"q": (97, 99)})
    assert [tuple(r) for r in lab.collect()] == [("Yes", 5), (None, 2)]


def test_codeframes(tmp_path):
    rows = [["Codes", "Label", "Anchored Verbatims"], ["", "Product (NET)", ""], ["", "Taste (Subnet)", ""], ["1", "Good taste", "masarap talaga; very tasty"], ["2", "Poor taste", "lasang karton"], ["", "Price (NET)", ""], ["3", "Affordable", "mura lang"]]
    frame = codeframes.from_xlsx(workbook.write([("Codes", rows)]))
    assert [(t["net"], t["subnet"], list(t["codes"])) for t in frame["topics"]] == [("Product", "Taste", ["pos"]), ("Product", "Taste", ["neg"]), ("Price", "General", ["pos"])]
    csv = codeframes.from_csv("﻿Theme,Category,Code,Quotes\nNice staff,Service,7,so kind\n".encode())
    assert csv["topics"][0]["net"] == "Service" and csv["topics"][0]["codes"]["neutral"]["code_id"] == 7
    with pytest.raises(ValueError, match="two labels"):
        codeframes.from_rows([["Code", "Label"], ["1", "a"], ["1", "b"]])
    with pytest.raises(ValueError):
        codeframes.load("../etc/passwd", [str(tmp_path)])
    import json

    (tmp_path / "base.json").write_text(json.dumps(CODEFRAME))
    (tmp_path / "more.json").write_text(json.dumps({**CODEFRAME, "topics": [{**CODEFRAME["topics"][0], "id": "extra"}], "includes": ["base"]}))
    assert [t["id"] for t in codeframes.load("more", [str(tmp_path)])["topics"]] == ["price", "service", "extra"]
    assert codeframes.suggested("Retail shop 2024", {"shop": ["shop"]}) == "shop" and codeframes.suggested("x", {"shop": ["shop"]}) is None


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "the staff is rude"), (2, "cheap")], "response_id int, t string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("response_id int, t string").parquet(f"{tmp_path}/in")
    answers.code_stream(stream, "t", CODEFRAME, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert {r.response_id: r.coded.sentiment for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "neg", 2: "pos"}


def test_stems_with_changed_sounds():
    roots = frozenset("bili dala bigay sama tulong inom sunod sulat kahoy tahi linis sabi".split())
    want = {"mamili": "bili", "mamimili": "bili", "dalhin": "dala", "bigyan": "bigay", "tulungan": "tulong", "inumin": "inom", "sundin": "sunod", "panulat": "sulat",
            "mangahoy": "kahoy", "manahi": "tahi", "nilinis": "linis", "sabihin": "sabi", "kasama": "kasama", "sasama": "sama"}
    assert {w: textprep.stem(w, roots) for w in want} == want


def test_census_refuses_what_it_cannot_hold(spark):
    many = lambda n: spark.createDataFrame([(f"Option {i:03d}",) for i in range(n) for _ in (0, 1)], "a string")
    assert len(multiselect.census(many(500), "a")) == 500
    for call in (multiselect.census, multiselect.resolved):
        with pytest.raises(ValueError, match="more than 500 options"):
            call(many(501), "a")


def test_scrubber_forms(spark):
    """Identity, phone and name forms that are masked, and words and numbers that look alike and stay."""
    masked = {
        "1234-5678-9012": "[ID]", "PSN 1234 5678 9012 3456": "PSN [ID]", "TIN 123 456 789": "TIN [ID]", "0817 123 4567": "[PHONE]", "(02) 8123 4567": "[PHONE]", "8123-4567": "[PHONE]",
        "1234-5678901-2": "[ID]", "12-3456789-0": "[ID]", "12-345678901-2": "[ID]", "+63 917 123 4567": "[PHONE]", "Tita Nena Cruz came": "Tita [NAME] came", "Aling Maria": "Aling [NAME]",
        "si juan kanina": "si [NAME] kanina", "kay Juan at Pedro": "kay [NAME] at Pedro", "Mr. De la Cruz went": "Mr. [NAME] went", "4111 1111 1111 1111": "[CARD]",
    }
    kept = ["kay ganda nito", "ni minsan", "order #2024", "I ate rice", "si mama", "costs 8,123.4567", "Mang Inasal", "a 1234 5678 count"]
    df = spark.createDataFrame([(t, w) for t, w in masked.items()] + [(t, t) for t in kept], "t string, want string")
    for r in df.withColumn("got", textprep.scrub_pii(F.col("t"), ["Mang Inasal"])).collect():
        assert r.got == r.want, r.t


def test_scales_with_unused_points(spark):
    from tallywright.operators import crosstab as ct

    rows = [(2 + i % 4, i % 4, 2 + i % 3, float(2 + i % 4), 7 + i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "q1 int, nps int, household_size int, half double, q5_rating int")
    got = {c: (ct.read_stub(df, c).low, ct.read_stub(df, c).high) for c in df.columns}
    assert got == {"q1": (1, 5), "nps": (None, None), "household_size": (None, None), "half": (1, 5), "q5_rating": (None, None)}
    assert ct.scale_of_values("q_satisfaction", 2, 4, 3, True) == (1, 5) and ct.scale_of_values("nps", 3, 10, 8, True) == (0, 10) and ct.scale_of_values("q", 1, 3, 3, True) is None


def test_omnibus_and_overlap(spark):
    from tallywright.operators import crosstab as ct

    rows = [(i, "ab"[i % 2], "xyz"[i % 3], 1 if i % 2 else 0, 1 if i % 5 else 0, f"{'A, B' if i % 4 else 'A'}, C", 1 + i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, g string, answer string, one int, two int, many string, score int")
    chi = ct.omnibus(df, "answer", ["g"]).first()
    assert chi.test == "chi_square" and chi.df1 == 2 and chi.stat == ct.crosstab_chi_square(df, "answer", "g").first().stat and chi.skipped is None
    assert ct.omnibus(df, "answer", ["one", "two"]).first().skipped and ct.omnibus(df, "many", ["one", "two"]).first().p is None
    assert ct.omnibus(df, "many", ["g"]).first().test == "rao_scott_2"
    f = ct.omnibus(df, "score", ["g"], metric="mean").first()
    assert f.test == "anova" and (f.df1, f.df2) == (1, 118) and abs(f.stat - ct.anova(df, "score", "g").first().f) < 1e-9
    assert ct.omnibus(df, "score", ["g"]).count() == 0


def test_numbers_sort_by_value(spark):
    from tallywright.operators import crosstab as ct

    df = spark.createDataFrame([("10",), ("2",), ("1",), ("b",), ("A",), ("11",)], "code string")
    assert [v for v, _ in ct.banners(df, ["code"])] == ["1", "2", "10", "11", "A", "b"]


def test_running_and_quantiles(spark):
    import numpy as np

    from tallywright.operators import ordered

    draw = random.Random(8)
    rows = [(draw.choice(["a", None]), round(draw.gauss(0, 1), draw.choice([1, 6]))) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    counts = df.filter("x is not null").groupBy("g", "x").agg(F.count("*").alias("k"))
    for r in ordered.running(counts, "x", "k", ["g"]).collect():
        assert r.upto == sum(1 for g, x in rows if g == r.g and x is not None and x <= r.x)
    got = {r.g: r.q for r in ordered.quantiles(df, F.col("x"), [0.0, 0.25, 0.5, 0.95, 1.0], ["g"]).collect()}
    for g in ("a", None, "one"):
        want = np.quantile([x for h, x in rows if h == g and x is not None], [0, 0.25, 0.5, 0.95, 1])
        assert np.allclose(got[g], want)
    assert "none" not in got and ordered.quantile(df.filter("x is null"), F.col("x"), 0.5) is None


def test_names_by_their_words():
    from tallywright.functions import names

    assert all(map(names.is_id, ("respondent_id", "id", "RespID", "order_no", "caseId"))) and not any(map(names.is_id, ("no", "paid", "valid", "q1")))
    assert names.is_time("duration") and names.is_time("TimeTaken") and names.is_time("completion_time") and not names.is_time("second_choice")
    assert names.is_rating("q3_1to5") and names.is_rating("sat_price") and not names.is_rating("saturday")
    assert names.is_open_end("q9_other") and names.is_code("area_code") and not names.is_code("code") and names.is_row_number("row_no")


def test_long_words_are_their_own_stem():
    roots = frozenset(("dala",))
    assert textprep.stem("ipinagdadalahan", roots) == "dala" and textprep.candidates("han" * 20) == ["han" * 20]


def test_comparative_flip():
    """Praise of a rival counts against, where the codeframe asks for it."""
    plain, flips = coding.Coder(CODEFRAME), coding.Coder({**CODEFRAME, "options": {"comparative_flip": True}})
    for text, was, now in [("mas mura ang iba", "pos", "neg"), ("mas mura ang other brand", "pos", "neg"), ("mas mura dito", "pos", "pos"), ("mura ang iba", "pos", "pos"), ("mas mahal ang iba", "neg", "neg")]:
        assert (plain.code(text)["sentiment"], flips.code(text)["sentiment"]) == (was, now), text


def test_codeframe_levels():
    rows = [["Code", "Label"], ["", "Service"], ["", "Staff (Subnet)"], ["", "Guards (Sub-subnet)"], ["1", "Bags checked"], ["", "Night (Sub-sub-subnet)"], ["2", "Slow guards"],
            ["", "Cashiers (Sub-subnet)"], ["3", "Change"], ["", "Problems with the place"], ["4", "Parking"], ["5", "Good light"], ["", "Price (NET)"], ["6", "Amount"]]
    got = [(t["net"], t["subnet"], list(t["codes"])[0]) for t in codeframes.from_rows(rows)["topics"]]
    assert got == [
        ("Service", "Staff > Guards", "neutral"), ("Service", "Staff > Guards > Night", "neg"), ("Service", "Staff > Cashiers", "neutral"),
        ("Service", "Problems with the place", "neg"), ("Service", "Problems with the place", "pos"), ("Price", "General", "neg"),
    ]


def test_triggers():
    from tallywright.functions.triggers import Triggers

    draw = random.Random(3)
    words = [("mura", 0), ("mura na", 1), ("a-b", 2), (" No.1 ", 3), ("ñandu", 4), ("ab", 5), ("ura", 6)]
    whole, anywhere = Triggers(words, whole=True), Triggers(words, whole=False)
    for _ in range(3000):
        text = "".join(draw.choice(["mura", "na", " ", "a-b", "no.1", "x", "_", "ñ", "andu", ".", "ku"]) for _ in range(draw.randrange(8)))
        clean = [(w.strip().lower(), n) for w, n in words if len(w.strip()) >= 3]
        assert whole.owners(text) == {n for w, n in clean if re.search(rf"\b{re.escape(w)}\b", text)}, text
        assert anywhere.owners(text) == {n for w, n in clean if w in text}
    assert Triggers([("ab", 1)], whole=True).owners("ab") == set()


def test_leaf_rows(spark):
    """An answer meets a leaf by code, theme, word or label; one that meets none stays in the base."""
    theme = lambda code, name: [(code, name, "n", "s", "t", "pos", 0.5)]
    rows = [(1, ("x", theme(101, "other"))), (2, ("x", theme(7, "GOOD PRICE"))), (3, ("x", theme(7, "price"))), (4, ("the cashiers", [])), (5, ("nothing", [])), (6, (None, None)), (7, ("a poor service here", theme(8, "")))]
    df = spark.createDataFrame(rows, f"r int, coded struct<text:string,themes:array<{openends.THEME}>>").withColumn("g", F.lit("all"))
    out = openends.leaf_rows(df, "r", CODEFRAME, ["g"])
    got = {}
    for r in out.collect():
        got.setdefault(r.r, set()).add(r.leaf)
    assert got == {1: {"Good price"}, 2: {"Good price"}, 3: {"Good price", "Poor price"}, 4: {"Good service", "Poor service"}, 5: {None}, 6: {None}, 7: {"Good service", "Poor service"}}
    table = {(r.level, r.net, r.leaf, r.banner): (r.n, round(r.pct, 1)) for r in openends.hierarchy(out, "r", "net", "subnet", "leaf", "g").collect()}
    assert table[1, "Offer", None, None] == (3, 42.9) and table[3, "Offer", "Poor price", "all"] == (1, 14.3) and table[1, "Service", None, None] == (2, 28.6)
    assert all(net for _, net, _, _ in table)


def test_learned_codes(spark):
    """Whole words give codes first, the predicted label else; what has no code goes to review."""
    learner = openends.PassiveAggressive(["Price", "Staff", "Elsewhere"])
    learner.update(["costly bill"] * 5 + ["they smile"] * 5 + ["far away town"] * 5, ["Price"] * 5 + ["Staff"] * 5 + ["Elsewhere"] * 5)
    rows = [(1, "the staff smile", "pos"), (2, "presyo at staff", "neutral"), (3, "they smile", "neg"), (4, "far away town", "pos"), (5, "  ", "neutral"), (6, "kumurap far away town", "neutral"), (7, None, None)]
    df = spark.createDataFrame(rows, "i int, t string, s string").withColumn("coded", F.struct(F.col("t").alias("text"), F.col("s").alias("sentiment")))
    got = {r.i: r.learned for r in learner.coded(df, CODEFRAME).collect()}
    assert got[1].codes == [111] and got[1].themes == ["Good service"] and got[2].codes == [101, 102, 111, 112]
    assert got[3].codes == [112] and got[3].label == "Staff" and 0 < got[3].margin <= got[3].confidence
    assert got[4].codes == [] and got[4].themes == ["Elsewhere"] and got[4].needs_review
    assert got[5].themes == got[7].themes == [] and got[5].needs_review and got[7].label is None
    assert got[6].codes == []  # mura is no word of it


def test_counters(spark):
    df = spark.createDataFrame([(1, "the staff is friendly"), (2, "none"), (3, "the staff is rude"), (4, "")], "response_id int, t string")
    out, seen = openends.counters(openends.coded(df, "t", CODEFRAME))
    assert out.count() == 4
    got = seen.get
    assert (got["answers"], got["special_none"], got["special_needs_review"], got["sentiment_pos"], got["sentiment_neg"], got["corrections"]) == (4, 1, 1, 1, 1, 0)


def test_respelled(spark):
    want = {"Diko alam kc mbango": "hindi ko alam kasi mabango", "ra gyud, PA DN!": "lang talaga, pa din!", "dito din": "dito din", "kcal dñ soff.": "kcal dñ sof & mmmm.", None: "", "di-di": "hindi-hindi"}
    df = spark.createDataFrame(list(want.items()), "t string, want string")
    for r in df.withColumn("got", textprep.respelled(F.col("t"))).collect():
        assert r.got == r.want, r.t
    assert df.limit(1).select(textprep.respelled(F.lit("cost xx"), {"xx": "$1\\"}).alias("t")).first().t == "cost $1\\"


def test_columns_by_default(spark):
    """Banners, banner groups and the open end where none is asked for."""
    from tallywright.operators import crosstab as ct

    rows = [("ab"[i % 2], "xyz"[i % 3], ["n", "s"][i % 2], f"answer {i} " + "long words " * 6, i) for i in range(60)]
    df = spark.createDataFrame(rows, "q string, r string, Gender string, why string, i int")
    assert [v for v, _ in ct.banners(df, [])] == ["n", "s"] and [v for v, _ in ct.banners(df, [], "Gender")] == ["a", "b"]
    assert [v for v, _ in ct.banners(df.drop("Gender"), [], "q")] == ["x", "y", "z"] and ct.banners(df.select("i"), []) == []
    groups = ct.banner_groups(df.select("i", "r", "q"), 2)
    assert [g for g, _ in groups] == ["x (A)", "y (B)"] and df.filter(groups[0][1]).count() == 20 and ct.banner_groups(df.select("i")) == []
    assert profiling.open_end(df) == "why" and profiling.open_end(df, "q") == "q" and profiling.open_end(df.select("i", "q")) is None
    assert profiling.open_end(df.select("q", F.lit("some words here and there").alias("z"))) == "z"
    assert {r.col_label for r in ct.crosstab(df, "q", []).collect()} == {"Total", "n", "s"}


def test_softmax_head(spark):
    draw = random.Random(4)
    texts = {"pos": ["very nice place", "love the friendly staff", "fast and clean"], "neg": ["so dirty and slow", "rude cashier", "terrible queue"], "neutral": ["went on monday", "near the station", "bought rice"]}
    rows = [(draw.choice(t), k) for k, t in texts.items() for _ in range(20)] + [("unlabelled", None)]
    head = openends.SoftmaxHead.fit(spark.createDataFrame(rows, "t string, label string"), "t", "label")
    out = head.apply(spark.createDataFrame([("nice clean place",), ("rude and dirty",), ("on monday near the station",), (None,)], "t string"), "t").collect()
    assert [r.head.label for r in out][:3] == ["pos", "neg", "neutral"] and all(1 / 3 <= r.head.confidence <= 1 for r in out)
    with pytest.raises(ValueError, match="2 to 100"):
        openends.SoftmaxHead.fit(spark.createDataFrame(rows[:20], "t string, label string"), "t", "label")
