from collections import defaultdict

from pyspark.sql import functions as F

from riskloom.llm import site_templates as st

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
<article><h1>Head &amp; tail</h1><p><b>One
 two.<br>three<p>Fo<i>ur</i> &lt;x&gt; &eacute;</p><aside>side</aside><ul><li>five<li>six</ul>
<form><input name=q><label>q</label></form></article><section id="comments"><p>first!</p></section>
<footer>&copy; me</footer></body></html>"""


def test_parse_page():
    blocks, _ = st.parse(PAGE)
    assert [t for t, _ in blocks] == ["Head & tail", "One two. three", "Four <x> é", "five", "six"]


def test_odd_pages():
    assert st.parse(None)[0] == [] and st.parse("")[0] == []
    assert [t for t, _ in st.parse("plain &amp; text")[0]] == ["plain & text"]
    assert [t for t, _ in st.parse("<p>a<p>b<div>c</div>d")[0]] == ["a", "b", "c", "d"]
    assert [t for t, _ in st.parse("<article><p>cut off <b>here")[0]] == ["cut off here"]
    assert [t for t, _ in st.parse("<p>x<script>1<2")[0]] == ["x"]
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert [t for t, _ in st.parse(deep)[0]] == ["deep"]
    assert len(st.parse("<p>" + "word " * 300_000)[0][0][0]) == 5 * 300_000 - 1


def _page(i, boxed=True):
    box = "<div><p>Follow us everywhere</p></div>" if boxed else ""
    return f"<html><body>{box}<div><p>Story {i} begins.</p><p>It ends {i}.</p></div><table><tr><td>All rights</td></tr></table></body></html>"


def brute(rows, min_pages, min_share):
    parsed = [(i, (u or "").split("/")[2] if u else "", *st.parse(h)) for i, u, h in rows]
    bodies, of = defaultdict(set), defaultdict(set)
    for _, host, blocks, body in parsed:
        of[host].add(body)
        for _, keys in blocks:
            for k in keys:
                bodies[host, k].add(body)
    gone = {hk for hk, b in bodies.items() if len(b) >= min_pages and len(b) >= min_share * len(of[hk[0]])}
    return sorted((str(i), " ".join(t for t, keys in blocks if not any((host, k) in gone for k in keys)))
                  for i, host, blocks, _ in parsed)


def test_templates_match_brute_force(spark):
    rows = [(i, f"http://a.example/{i}", _page(i)) for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", _page(99)) for i in range(6)]        # copies of one page: no template
    rows += [(40, None, None), (41, "http://a.example/x", ""), (0, "http://a.example/0", _page(0)), (None, "http://c.example", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumn("text", F.lit("clash"))
    got = st.extract(df).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == brute(rows, st.MIN_PAGES, st.MIN_SHARE)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "Story 3 begins. It ends 3." and "Follow us" in text[21] and text[40] == "" == text[41]
    assert all(r.n_chars == len(r.text) for r in got)
    assert st.extract(df.limit(0)).count() == 0


def _texts(spark, rows):
    return {r.page_id: r for r in st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def _words(i, n=30):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_counts_decide_about_named_parts_and_articles(spark):
    """Menus, adverts and footers that change their words are found by their tags on the host, also on pages whose
    article is shorter than they are; a line that ends every article goes, a quoted one stays."""
    def page(i, n):
        menu = "".join(f"<li><a href='/{i}{k}'>menu {i} {k}</a></li>" for k in range(6))
        quote = "<p>To be or not.</p>" if i < 4 else ""
        return (f"<html><body><nav><ul>{menu}</ul></nav><div class='ad'>buy {_words(i, 6)}</div><div>Lead {i}.</div><article><p>{_words(i, n)}</p>"
                f"{quote}<p>Thanks for reading.</p></article><footer>&copy; {_words(i + 100, 8)}</footer></body></html>")
    rows = [(i, f"http://a.example/{i}", page(i, 1 if i == 7 else 60)) for i in range(12)]
    got = _texts(spark, rows)
    assert got[7].text == "Lead 7. w7x0" and got[2].text == f"Lead 2. {_words(2, 60)} To be or not."
    assert got[7].n_template_blocks == 9 and got[7].n_blocks == 11       # 6 links, advert, footer, last line


def test_names_never_take_the_main_text(spark):
    shells = ["<div class='layout has-sidebar'>{}</div>", "<article class='post tag-social format-form'>{}</article>", "<form id='aspnetForm'>{}</form>",
              "<div class='sidebar'>{}</div>", "<div><div class='teaser'><article><p>Card</p></article></div>{}</div>"]
    for k, shell in enumerate(shells):
        rows = [(i, f"http://{k}.example/{i}", "<body>" + shell.format(f"<div class='article-header'><h1>Title {i}</h1></div><div>{_words(i)}</div>")
                 + "<div class='ad'>buy</div></body>") for i in range(4)]
        for i, r in _texts(spark, rows).items():
            assert f"Title {i} {_words(i)}" in r.text and "buy" not in r.text, (k, r.text)


def test_bar_does_not_grow_with_the_host(spark):
    def page(i, of):
        box = "<div>In this section</div>" if i < 12 else "<table><tr><td>Own data</td></tr></table>" if i < 15 else ""
        return f"<body>{box}<div><p>{_words(i, 5)}</p></div></body>"
    for of in (30, 400):
        got = _texts(spark, [(i, f"http://h{of}.example/{i}", page(i, of)) for i in range(of)])
        assert got[3].text == _words(3, 5) and got[13].text == f"Own data {_words(13, 5)}"


def test_wrapped_in_a_form_copies_still_count_once(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><form><div class='ad'>{_words(i, 3)}</div><div><p>{_words(0)}</p></div></form></body>") for i in range(12)]
    rows += [(50 + i, f"http://b.example/{i}", f"<body><form><nav>x y</nav><div><p>{_words(i)}</p></div></form></body>") for i in range(12)]
    got = _texts(spark, rows)
    assert got[3].text == _words(0) and got[53].text == _words(3)


def test_seldom_subtrees_are_joined(spark, monkeypatch):
    """Subtrees too seldom for the driver give the same result by the join."""
    monkeypatch.setattr(st, "hot_floor", lambda n: 10 ** 9)
    test_counts_decide_about_named_parts_and_articles(spark)
    test_names_never_take_the_main_text(spark)
