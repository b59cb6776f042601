import hashlib
import math
import random
import re

from tallywright.llm import pii

from .cases import DOC_SCHEMA, documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    check = lambda d: sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and check(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


def test_spans_equal_the_patterns():
    draw = random.Random(4)
    parts = ["a", "B.c", "@", "@x.y", ".", "-", " ", "1", "12", "255", "256", "+", "+1", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "é", "%", "_", "\n", "007", "0"]
    for _ in range(30000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(14)))
        assert pii.base_spans(text) == brute(text), text


def test_cores_are_the_words():
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choice(["a", "B", "é", ".", "-", "'", " ", "\n", "\u00a0", "(", "x" * 70]) for _ in range(draw.randrange(40)))
        assert pii.cores(text) == {w for w, _, _ in pii.words(text)}


def test_long_runs_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" + " " * 400_000, "1 " * 200_000, "+" * 400_000, "a" * 200_000 + "@"):
        pii.base_spans(text)


def test_cases(spark):
    rows = [(1, "mail me.x@mail.example.com or +44 (20) 7946-0958", "en", "a", 1), (2, None, None, None, None), (2, None, None, None, None), (3, "ip 10.1.2.3, card 4111 1111 1111 1111", "en", "a", 1), (None, "é@b.cd", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOC_SCHEMA).selectExpr("*", "1 as own", "2 as k", "3 as term", "4 as spans")
    got = sorted(pii.sanitised(df).collect(), key=lambda r: (r.doc_id or 0, r.spans))
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[2].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest() and by[2].clean_text == ""
    assert by[1].clean_text == "mail [EMAIL] or [PHONE]" and (by[1].n_email, by[1].n_phone) == (1, 1)
    assert by[1].spans == "email:5:26,phone:30:48" and by[1].base_sha256 == hashlib.sha256(b"email:5:26,phone:30:48").hexdigest()
    assert by[3].clean_text == "ip [IP], card [CARD]"
    assert by[None].n_email == 0
    assert pii.sanitised(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    out = pii.cleaned(documents(spark))
    assert out.count() == 15 and set(out.columns) == set(documents(spark).columns)


def test_revealing_terms(spark, monkeypatch):
    """A name that stands near an address in many surroundings, and hardly elsewhere, gives it away."""
    draw = random.Random(6)
    word = lambda: f"w{draw.randrange(40)}"
    rows = [(i, f"{word()} {word()} Zorblatt {word()} z@mail.example.com {word()} {word()}", "en", "a", 1) for i in range(6)]
    rows += [(10 + i, " ".join(word() for _ in range(12)), "en", "a", 1) for i in range(200)]
    rows += [(300 + i, "copy Quuxly writes from q@mail.example.com always", "en", "a", 1) for i in range(20)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    got = {r.term: r.share for r in pii.revealing_terms(df).collect()}
    assert set(got) == {"zorblatt"} and got["zorblatt"] > 0.95  # copies prove nothing
    clean = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert clean[0].n_term == 1 and "Zorblatt" not in clean[0].clean_text and "[REMOVED]" in clean[0].clean_text
    assert clean[300].n_term == 0 and clean[15].clean_text == rows[11][1]
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)  # the way for many terms gives the same
    again = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert again == clean


def test_query_on_table_with_planted_names(spark):
    """All of sf0.01 and a few texts that give addresses away, against brute force for spans and terms."""
    draw = random.Random(12)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    plain = [t for _, t in rows if t and 200 < len(t) < 2000]
    for i in range(8):
        rows.append((10**6 + i, f"{draw.choice(plain)} Vrobnik ({'+44 20 7946 0958' if i % 2 else 'v.k@mail3.example.com'}) {draw.choice(plain)}"))
    found = {k: brute(t or "") for k, (_, t) in enumerate(rows)}
    texts, entities = {}, {}
    for k, (_, t) in enumerate(rows):
        spans = sorted((a, b, x) for x, v in found[k].items() for a, b in v)
        inside = lambda a, b: any(a < y and x < b for x, y, _ in spans)  # noqa: B023, E731
        texts[k] = {w for w, a, b in pii.words(t or "") if not inside(a, b)}
        for a, b, x in spans:
            entities.setdefault(f"{x}:{t[a:b].lower()}", []).append(k)
    every = {}
    for k, (_, t) in enumerate(rows):
        for w in {w for w, _, _ in pii.words(t or "")}:
            every[w] = every.get(w, 0) + 1
    shares, n = {}, len(rows)
    for docs in entities.values():
        docs = sorted(set(docs))
        for w in {w for k in docs for w in texts[k]}:
            both = [k for k in docs if w in texts[k]]
            if len({rows[k][1] for k in both}) >= pii.SUPPORT:
                share = math.log2(len(both) * n / (len(docs) * every[w])) / math.log2(n / len(docs))
                if share >= pii.GENERALISE:
                    shares[w] = max(shares.get(w, 0), share)
    assert "vrobnik" in shares
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitised(df).collect()}
    for k, (i, t) in enumerate(rows):
        base = [f"{x}:{a}:{b}" for x in ("email", "ip", "card", "phone") for a, b in found[k][x]]
        spans = [s for v in found[k].values() for s in v]
        terms = [f"term:{a}:{b}" for w, a, b in pii.words(t or "") if w in shares and not any(a < y and x < b for x, y in spans)]
        assert got[i].spans == ",".join(base + terms) and got[i].n_term == len(terms)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_terms_count_over_whole_texts(spark):
    """A signature repeated in different texts, a name far from the value and a name of two characters are found."""
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(40)}"
    some = lambda n: " ".join(word() for _ in range(n))
    signature = "Best wishes and kind regards, Wibbleton at s@mail.example.com over and out"
    rows = [(i, f"{some(8)} {signature}", "en", "a", 1) for i in range(9)]
    rows += [(20 + i, f"Farrow {some(15)} f@mail.example.com", "en", "a", 1) for i in range(5)]
    rows += [(40 + i, f"{some(3)} 李明 ({some(1)}) m@mail.example.com", "en", "a", 1) for i in range(4)]
    rows += [(100 + i, some(12), "en", "a", 1) for i in range(200)]
    rows += [(400 + i, "Twice t@mail.example.com", "en", "a", 1) for i in range(3)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    n = len(rows)
    holds = lambda i, w: w in {x.strip("(),.").lower() for x in rows[i][1].split()}
    want = {}
    for entity in ("s", "f", "m", "t"):
        docs = [i for i in range(n) if holds(i, f"{entity}@mail.example.com")]
        for w in {x.strip("(),.").lower() for i in docs for x in rows[i][1].split() if "@" not in x}:
            both = [i for i in docs if holds(i, w)]
            if len({rows[i][1] for i in both}) >= 3:
                share = math.log2(len(both) * n / (len(docs) * sum(holds(i, w) for i in range(n)))) / math.log2(n / len(docs))
                if share >= pii.GENERALISE:
                    want[w] = max(want.get(w, 0), share)
    assert {"wibbleton", "farrow", "李明"} <= set(want) and "twice" not in want
    got = {r.term: r.share for r in pii.revealing_terms(df).collect()}
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    clean = {r.doc_id: r.clean_text for r in pii.sanitised(df).collect()}
    assert "Wibbleton" not in clean[0] and "Farrow" not in clean[20] and "李明" not in clean[40]
