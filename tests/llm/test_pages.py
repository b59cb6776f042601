import glob
import gzip
import hashlib
import random

from tallywright.llm import mainhtml, urlfilter, warc

PAGE_SCHEMA = "page_id long, url string, html string"
LONG = "<p>" + "payload " * 30 + "</p>"
PAGES = [
    (1, "http://a.example.com/en/1", LONG), (2, "http://b.example.com/en/2", LONG), (3, None, LONG), (3, None, LONG), (4, "odd url\r\nwith lines", None),
    (5, "http://a.example.com/en/1", ""), (6, "x", "short"), (7, "y", "short"), (None, "z", LONG), (8, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n" * 3), (9, "v", "x" * 300000),
]


def test_archives(spark, tmp_path):
    df = spark.createDataFrame(PAGES, PAGE_SCHEMA).selectExpr("*", "1 as payload", "2 as original", "3 as digest")
    path = f"file://{tmp_path}/w"
    got = sorted(map(tuple, warc.archived(df, path).collect()), key=str)
    want = []
    for i, url, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if h == html and p is not None), default=None) if len(data) >= 100 else None
        again = i is not None and first is not None and first < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, url))
    assert got == sorted(want, key=str)
    records = [r for f in glob.glob(f"{tmp_path}/w/part-*") for r in warc.parse(gzip.open(f).read())]
    assert len(records) == len(PAGES) and sum(len(b) for _, b in records) < sum(len((h or "").encode()) for _, _, h in PAGES)
    full = {(r.page_id, bytes(r.payload)) for r in warc.with_payloads(warc.read_archives(spark, path)).collect()}
    assert full == {(i, (h or "").encode()) for i, _, h in PAGES}
    warc.deduplicated(spark, path, path + "2")
    again = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, path + "2").collect()), key=str)
    assert again == sorted(((w[0], w[3], w[4]) for w in want), key=str)
    assert warc.archived(spark.createDataFrame([], PAGE_SCHEMA)).collect() == []


def test_archive_format(spark, tmp_path, monkeypatch):
    """Bounded archives, a gzip member for each record, and revisits that name their response."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)  # the shuffle gives the same
    warc.archived(spark.createDataFrame(PAGES, PAGE_SCHEMA).coalesce(1), f"file://{tmp_path}/w").collect()
    ids, refers = {}, []
    for f in glob.glob(f"{tmp_path}/w/part-*"):
        parts = [x for x in warc.unzipped(open(f, "rb").read()) if x]
        assert len(parts) == 1 or sum(map(len, parts)) <= 3000
        for part in parts:
            (h, payload), = warc.parse(part)
            if h["warc-type"] == "response":
                ids[h["warc-record-id"]] = hashlib.sha256(payload).hexdigest()
            else:
                refers.append((h["warc-refers-to"], h["warc-payload-digest"]))
    assert len(refers) == 3 and all("sha256:" + ids[to] == digest for to, digest in refers)


def plain_verdict(url):
    import re

    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_urls(spark):
    draw = random.Random(5)
    hosts = ["com", "example.com", "a.example.com", "EXAMPLE.com", "badexample.com", "net", "x.net", "example.net", "org", "w.org", "", "comx", ".com", "a..com", "É.com"]
    paths = ["/en/", "/en/7", "/en/728", "/en", "/de/8", "/de/", "/de/81?x=/es/", "/es/1#a", "", "/", "?q", "#f", "/EN/7"]
    urls = [None, "", "no scheme", "://", "http:/x", "a://b://com/en/"] + [f"{draw.choice(['http', 'https', ''])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://com/en/")], "page_id long, url string").selectExpr("*", "1 as host", "2 as path", "3 as key", "4 as best")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(df).collect()}
    assert got == {**{i: plain_verdict(u) for i, u in enumerate(urls)}, None: plain_verdict("http://com/en/")}
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_cascade_is_exact(spark):
    listed = spark.createDataFrame([(f"bad{i}",) for i in range(300)], "key string")
    universe = spark.createDataFrame([(f"bad{i}",) for i in range(0, 300, 2)] + [(f"good{i}",) for i in range(20000)] + [(None,)], "key string")
    levels = urlfilter.cascade(listed, universe)
    assert len(levels) >= 2
    from pyspark.sql import functions as F

    wrong = universe.filter(urlfilter.member(levels, F.col("key")) != F.coalesce(F.col("key").startswith("bad"), F.lit(False)))
    assert wrong.count() == 0


def test_long_lists(spark, monkeypatch):
    """200,000 listed keys: a cascade of bounded size that follows the list, and the join beyond the bound give the same."""
    rules = spark.range(200_000).selectExpr("if(id % 3 = 0, 'allow', 'block') verdict", "concat('h', id, '.com') host", "if(id % 2 = 0, '/', '/p/') path")
    urls = spark.range(3000).selectExpr("id page_id", "concat('http://w.h', id * 97, '.com/p/', id) url").union(spark.createDataFrame([(1, "http://w.h97.com/p/1"), (None, None)], "page_id long, url string"))
    levels = urlfilter.cascade(rules.selectExpr("concat(host, '\n', path) key"), spark.range(100_000).selectExpr("concat('g', id, '\n') key"))
    assert sum(len(x.words) for x in levels) < 200_000 * 6 / 64
    got = sorted(str(tuple(r)) for r in urlfilter.judged(urls, rules).collect())
    want = []
    for i, url in [(i, f"http://w.h{i * 97}.com/p/{i}") for i in range(3000)] + [(1, "http://w.h97.com/p/1"), (None, None)]:
        host, path = (url[7:].split("/", 1)[0], "/" + url[7:].split("/", 1)[1]) if url else ("", "")
        n = int(host[3:-4]) if url else 0
        hit = url and n < 200_000
        want.append(str((i, host, path, f"h{n}.com" + ("/" if n % 2 == 0 else "/p/") if hit else None, ("allow" if n % 3 == 0 else "block") if hit else "allow")))
    assert got == sorted(want)
    monkeypatch.setattr(urlfilter, "MOST_WORDS", 1)
    assert sorted(str(tuple(r)) for r in urlfilter.judged(urls, rules).collect()) == got


def page(body, title="T"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p>";</script><style>p{{}}</style></head><body>{body}</body></html>'


def test_extraction(spark):
    nav = '<nav><ul><li><a href="/a">Menu</a></ul></nav>'
    body = "<h1>Title &amp;amp; more</h1><p><b>First  &lt;one&gt;\n here.<br><p>Second <i>part</i>.<p>Third.</p>"
    text = "Title &amp; more\nFirst <one> here.\nSecond part.\nThird."
    rows = [
        (1, "http://h.example/1", page(f'{nav}<div class="ad">Buy</div><article>{body}</article><div id="comments"><p>nice</p></div><footer>&copy; x</footer>')),
        (2, "http://h.example/2", page(f'{nav}<article>{body}<aside>more</aside><form>Name <input><button>Go</button></form></article><div class="cookie-notice">OK?</div>')),
        (3, "http://h.example/3", None),
        (4, None, "plain text &amp; nothing  else"),
        (5, "http://g.example/5", page(f'<div class="top"><a href="/">Home</a></div><div class="post n12">{body}</div><div class="side"><p>links</p></div>')),
        (6, "http://g.example/6", page('<div class="top"><a href="/">A much longer line of links than the post itself has, by far, in this page</a></div><div class="post n13"><p>Tiny.</p></div>')),
        (7, "http://x.example/7", "<p>a < b <unclosed <b>c</b><!-- never ends"),
        (8, "http://x.example/8", '<div title="a>b">quoted</div><p title=">x'),
        (None, "http://h.example/9", page(f"<article>{body}</article>")),
    ]
    got = {r.page_id: r.text for r in mainhtml.extracted(spark.createDataFrame(rows, PAGE_SCHEMA).selectExpr("*", "1 as text", "2 as path", "3 as host")).collect()}
    assert got[1] == got[2] == got[None] == got[5] == text
    assert got[3] == "" and got[4] == "plain text & nothing else" and got[6] == "Tiny."
    assert got[8].startswith("quoted") and "a < b" in got[7]
    assert mainhtml.extracted(spark.createDataFrame([], PAGE_SCHEMA)).collect() == []


def test_many_hosts_are_joined(spark, monkeypatch):
    monkeypatch.setattr(mainhtml, "BROADCAST_HOSTS", 0)
    test_extraction(spark)


def test_table_pages(spark):
    import re

    for r in mainhtml.extracted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(re.sub(r"<[^>]+>", "", b).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        import html

        assert r[2] == html.unescape("\n".join(b for b in blocks if b)) and r.n_chars == len(r[2])


def test_hard_pages_are_linear():
    for text in ("<" * 200_000, "<div>" * 50_000, "<a href='" * 30_000, "<!--" * 100_000, "</p>" * 100_000, "<p>" * 50_000, "<div><p>" * 20_000 + "</span>" * 20_000, "<script>" * 30_000, "&amp" * 100_000):
        mainhtml.main_text(text, None)


def test_whole_texts_are_kept(spark):
    """Title, lead and last section, pages of another template, and main text in elements with a boilerplate word."""
    menu = '<div class="top"><a href="/">Home</a> <a href="/b">Blog</a></div>'
    say = lambda w, n: " ".join([w] * n)
    parts = (say("title", 2), say("lead", 20), say("body", 150), say("more", 15))
    post = '{}<div class="post"><h1>{}</h1><p>{}</p><div class="body"><p>{}</p></div><div class="more"><p>{}</p></div></div>'.format(menu, *parts)
    rows = [(i, "http://h.example/", page(post)) for i in range(3)]
    rows.append((3, "http://h.example/", page(f'{menu}<div class="post">Short.</div><div class="story"><p>{say("story", 80)}</p></div>')))
    rows.append((4, "http://i.example/", page(f'{menu}<div id="content" class="with-sidebar"><p>{say("text", 60)}</p><div class="sidebar">{say("aside", 9)}</div></div><p>End.</p>')))
    rows.append((5, "http://j.example/", page(f'<article><p>{say("piece", 10)}</p></article><div class="comments"><p>{say("comment", 90)}</p></div>')))
    got = {r.page_id: r.text for r in mainhtml.extracted(spark.createDataFrame(rows, PAGE_SCHEMA)).collect()}
    assert got[0] == got[1] == got[2] == "\n".join(parts)
    assert got[3] == "Home Blog\nShort.\n" + say("story", 80)  # links beside several parts stay
    assert got[4] == "Home Blog\n" + say("text", 60) + "\nEnd."
    assert got[5] == say("piece", 10)
    mainhtml.main_text('<div class="menu">text ' * 20_000, None)  # linear


def test_article_parts_are_kept(spark):
    """A heading in an article's header, ordinary names with a boilerplate word in them, formulas, repeated rows."""
    inner = '<header><h1>Title</h1></header><div class="article-header"><h2>Sub</h2></div><p>Lead with <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p>'
    inner += '<div class="ad-hoc"><p>One.</p></div><div id="menu-of-options"><p>Two.</p></div><div class="social"><p>Three.</p></div>'
    text = "Title\nSub\nLead with x=1.\nOne.\nTwo.\nThree."
    drop = '<div class="ad-banner">Buy</div><nav>Menu</nav><div class="comment-list"><p>nice</p></div><div id="cookie_notice">OK</div><footer>end</footer><div class="sidebar">side</div>'
    html = page(f'<header><h1>Site</h1></header><div class="menu-main">Menu</div><article>{inner}{drop}</article><div class="site-header">x</div>')
    rows = [(1, "http://h.example/1", html), (1, "http://h.example/1", html), (2, "http://h.example/2", html)]
    got = [(r.page_id, r.text) for r in mainhtml.extracted(spark.createDataFrame(rows, PAGE_SCHEMA)).collect()]
    assert sorted(got) == [(1, text), (1, text), (2, text)]
