import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import openends, reporting, rules
from tallywright.plans.catalog import CODEFRAME

RULES = [
    rules.CodeRule(110, "Affordable", ("mura", "cheap", "affordable"), "Positive", "Price", opposite=120),
    rules.CodeRule(120, "Expensive", ("mahal", "expensive"), "Negative", "Price", opposite=110),
    rules.CodeRule(130, "Budget", (r"\bbudget\w*",), "Positive", "Price", lump_into=110),
]


def test_rules(spark):
    texts = ["mura naman", "hindi masyadong mahal", "ang mahal, pero not cheap", "hindi lang mura", "wala", "asdfgh", "ok lang", None, "", "budget-friendly"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    codes = lambda **kw: {r.i: [c.code_id for c in r.codes] for r in rules.rule_coded(df, "t", RULES, **kw).collect()}
    got = codes()
    assert got == {0: [110], 1: [110], 2: [120], 3: [110], 4: [999], 5: [998], 6: [900], 7: [], 8: [], 9: [130]}
    assert codes(lump=True)[9] == [110]


def test_intervals_and_kappa(spark):
    df = spark.createDataFrame([(50, 100), (0, 10), (0, 0)], "k int, n int")
    low, high = reporting.wilson(F.col("k"), F.col("n"))
    got = [(r.l, r.h) for r in df.select(low.alias("l"), high.alias("h")).collect()]
    assert got[0] == (pytest.approx(0.4038, abs=1e-4), pytest.approx(0.5962, abs=1e-4)) and got[1][0] == pytest.approx(0, abs=1e-9) and got[2] == (None, None)
    pairs = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    r = reporting.cohen_kappa(spark.createDataFrame(pairs, "x string, y string"), "x", "y").first()
    assert r.agreement == 0.7 and r.kappa == pytest.approx(0.4)


def test_metrics_and_gate(spark):
    rows = [("p", "p", "pos", "pos", False)] * 9 + [("q", "p", "neg", "pos", True), ("p", "OUT_OF_SCOPE", "pos", "pos", False)]
    r = reporting.coder_metrics(spark.createDataFrame(rows, "t string, et string, s string, es string, u boolean"), "t", "et", "s", "es", F.col("u")).first().asDict()
    assert (r["other_pct"], r["theme_agree_pct"], r["sent_acc_pct"]) == (9.1, 90.0, 90.9)
    assert reporting.gate(r)["other_pct"] and reporting.gate(r)["theme_agree_pct"] and not reporting.gate({})["sent_acc_pct"]


def test_defaults(spark):
    df = spark.createDataFrame([("R%d" % i, ["N", "S"][i % 2], ["x", "y", "z"][i % 3]) for i in range(60)], "Respondent_ID string, Region string, Brand string")
    t = reporting.default_table(df).collect()
    assert {r.label for r in t} == {"x", "y", "z"} and {r.col_label for r in t} == {"Total", "N", "S"}
    assert reporting.default_targets(df, "Region", {"N": 0.4, "S": 0.6}) == {"Region": {"N": 0.4, "S": 0.6}}
    with pytest.raises(ValueError):
        reporting.default_targets(df, "Region", {"N": 1.0})


def test_snapshot_and_topics(spark):
    df = spark.createDataFrame([(1, "the staff is friendly"), (2, "so expensive")], "response_id int, t string")
    themes = openends.theme_frequencies(openends.coded(df, "t", CODEFRAME))
    assert {(r.kind, r.quote) for r in reporting.snapshot(themes, ["Good"]).collect()} == {("delight", "the staff is friendly"), ("friction", "so expensive")}

    def embed(texts):
        return np.stack([openends.hashed(t) for t in texts])

    near = reporting.nearest_topics(df, "t", CODEFRAME, embed, 0.05).collect()
    assert near[0].topic == "service"


def brute_codes(text, coded, lump):
    """The rule coder word by word; ``coded`` has (code, words, opposite)."""
    text = (text or "").strip(" ")
    if not text:
        return []
    low = text.lower()
    if re.fullmatch(r"(none|nothing|wala|n/?a|no comment|wala naman)[\s.!]*", low):
        return [999]
    if re.fullmatch(r"[\W\d_]*|([^\W\d_])\1{2,}|asdf\w*|qwer\w*|test+", low):
        return [998]
    out = []
    for code, words, opposite in coded:
        plain = turned = False
        for clause in re.split(r"[.!?;,\n]+|\b(?:pero|but|kaso|however)\b", low):
            alone = re.findall(r"\w+", clause)
            if not set(alone) & set(words):
                continue
            chunks = re.findall(r"[\w'-]+", clause)
            exempt = any(re.search(rf"\b{e}\b", clause) for e in rules.EXCEPTIONS)
            negated = any(set(re.findall(r"\w+", c)) & set(words) and set(rules.NEGATORS) & set(chunks[max(0, i - 3) : i]) for i, c in enumerate(chunks)) and not exempt
            plain, turned = plain or not negated, turned or negated
        out += [lump.get(code, code)] * plain + ([opposite] * turned if opposite else [])
    return list(dict.fromkeys(out)) or [900]


def test_whole_rule_codes(spark):
    """Texts as they stand: negators, letters beyond ASCII, opposite codes and lumping."""
    from tallywright.plans import catalog

    coded, lump = [(r.code_id, r.patterns, r.opposite) for r in catalog.OPPOSED], {r.code_id: r.lump_into for r in catalog.OPPOSED if r.lump_into}
    got = {(r.conv_id, r.turn): r.codes for r in catalog.rule_codes_whole(spark, "/root/testdata/sf0.01").collect()}
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    assert len(got) == len(table)
    assert [(r.text, got[r.conv_id, r.turn]) for r in table if got[r.conv_id, r.turn] != brute_codes(r.text, coded, lump)] == []
    texts = ["the shop", "not the shop", "no señor él the shop", "no ñu ñu ñu the shop", "ethé thee théthe", "und", "not und", "hindi lang the", "never absent", "dili missing, and", "no the but the", "é", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    codes = [[c.code_id for c in r.codes] for r in rules.rule_coded(df, "t", catalog.OPPOSED, lump=True).orderBy("i").collect()]
    assert codes == [[1], [3], [3], [1], [900], [1], [900], [1], [1], [1], [1, 3], [900], []]
    assert codes == [brute_codes(t, coded, lump) for t in texts]


def test_senses_and_roots(spark):
    """ "Mahal" as love or expense, and patterns that only the roots of the words meet."""
    loved = [*RULES, rules.CodeRule(340, "Affinity", ("favourite",), "Positive", "Brand"), rules.CodeRule(350, "Buying", ("bili",))]
    texts = ["mahal ko ang brand", "mahal ko pero mahal ang presyo", "mahal ko sana, presyo lang", "hindi mahal, loyal ako", "ang mahal", "love it, mahal", "mahal ko ang presyo", "mamili ako", "hindi mabilhan"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = rules.rule_coded(df, "t", loved, senses=[rules.mahal(340)], roots=["bili", "mahal"]).orderBy("i").collect()
    assert [[c.code_id for c in r.codes] for r in rows] == [[340], [340, 120], [340], [110], [120], [120], [120], [350], [900]]


def test_report_tables(spark):
    """The report's sections hold what the operators give, as a workbook and as a page."""
    from tallywright.operators import crosstab as ct
    from tallywright.operators import weighting
    from tallywright.sources import exports, workbook

    rows = [("ab"[i % 2], "xyz"[(i * i) % 3], 1 + i % 5, 99 if i % 10 == 0 else 1 + i % 5, 1.0 + i % 2, f"<b>{'friendly staff' if i % 2 else 'so expensive'}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, q string, score int, Satisfaction int, w double, t string, response_id int")
    themes = openends.theme_frequencies(openends.coded(df, "t", CODEFRAME))
    out = reporting.tables_for_report(df, ["g", "q"], [("q", ["g"])], ["score"], themes, "w")
    assert [s.title for s in out] == ["Characteristics of the respondents", "q by g", "Means and standard deviations", "Themes of the answers"]
    assert out[0].rows[1] == ["g", "a", 30, 50.0, 30.0] and out[0].rows[2] == ["g", "b", 30, 50.0, 60.0]
    test = ct.omnibus(df, "q", ["g"], "w").first()
    assert out[1].note == f"Chi-square(1) = {test.stat:.2f}, p = " + f"{test.p:.3f}".removeprefix("0") and out[1].rows[1] == ["Base", 60, 30, 30]
    assert out[2].rows[1][:3] == ["score", 60, 3.0]
    book = workbook.Workbook(exports.sections_book(out))
    assert len(book.sheets) == 4
    page = exports.sections_page(reporting.snapshot_sections(df, themes, ["Good"], "w"), "A & B")
    assert "A &amp; B" in page and "&lt;b&gt;friendly staff" in page and "<b>" not in page and "Delights" in page
    figures = dict(reporting.key_figures(df, "w").rows[1:])
    kept = [r for r in rows if r[3] != 99]
    assert figures["Respondents"] == 60 and figures["Satisfaction, %"] == pytest.approx(100 * sum(r[4] for r in kept if r[3] >= 4) / sum(r[4] for r in kept))
    assert figures["Effective base"] == pytest.approx(weighting.weight_diagnostics(df, "w").first().neff) and reporting.satisfaction(df.drop("Satisfaction")) is None
    assert reporting.omnibus_line(None) == "" and "overlap" in reporting.omnibus_line(ct.omnibus(df.withColumn("one", F.lit(1)).withColumn("two", F.lit(1)), "q", ["one", "two"]).first())
