"""Element table and selectors (H1-H12) on hand-written pages."""

from conftest import FB

from sitesift.operators import structure as S
from sitesift.operators.htmltree import parse_html, parse_pages


def test_tree_rules_on_malformed_html():
    text, els, nodes = parse_html("<div><p>a<b>b</p>c</div>d</span><br>e<p>x<p>y")
    tags = [e["tag"] for e in els]
    assert tags == ["div", "p", "b", "br", "p", "p"]
    # </p> closes the open <b> too; the stray </span> is ignored; <p> does not close <p>
    assert els[2]["parent_id"] == 1 and els[4]["parent_id"] == -1 and els[5]["parent_id"] == 4
    assert text == "abcdexy"


def test_text_is_concatenation_of_nodes_and_offsets_hold():
    html = ("<html><head><title>T&amp;S</title><script>var t=\"</p>\";</script><style>p{}</style></head>"
            "<body>\n  <p>a &copy; b</p><!-- c --><p>d</p>\n</body></html>")
    text, els, nodes = parse_html(html)
    assert text == "".join(text[n["start"]:n["end"]] for n in nodes)
    assert "var t" not in text and "p{}" not in text and " c " not in text
    assert "T&S" in text and "a © b" in text
    p = [e for e in els if e["tag"] == "p"]
    assert [text[e["text_start"]:e["text_end"]] for e in p] == ["a © b", "d"]
    # whitespace-only strings collapse to one newline
    assert text.startswith("T&S\n")


def test_script_raw_text_kept_only_for_scripts():
    _, els, _ = parse_html('<script type="application/ld+json">{"a": 1}</script><p>x</p>')
    assert els[0]["raw_text"] == '{"a": 1}' and els[1]["raw_text"] is None


def test_selectors_golden_fb(spark, pages_of):
    p = parse_pages(pages_of(FB)).cache()
    blocks = {(r.keyword, r.weight, r.via) for r in S.context_blocks(p).collect()}
    assert blocks == {("about", "high", "class"), ("team", "high", "class")}
    sib = S.header_siblings(p).collect()
    assert [(r.weight, r.text) for r in sib] == [("high", "Dr. Yuki Sato Chief Officer")]
    vc = {(r.type, r.value) for r in S.vcards(p).collect()}
    assert vc == {("name", "Ana Ruiz"), ("organization", "Acme Org"), ("email", "ana@x"), ("phone", "n/a")}
    js = {(r.type, r.value) for r in S.jsonld(p).collect()}
    assert js == {("name", "Ravi Menon"), ("title", "VP"), ("phone", "555")}   # first list item; bad JSON: none
    assert [r.value for r in S.mailto(p).collect()] == ["jo@site-b.example.com"]
    assert [(r.text, r.href) for r in S.links(p).collect()] == [("Contact Jo Park", "mailto:jo@site-b.example.com")]
    t = S.page_text(p).first().text
    assert t.startswith("Lena Vogel Project Managerlena@site-b.example.comCall (212) 555-0103Our People")


def test_jsonld_edge_cases(spark, pages_of):
    scripts = ['[]', '', '{"@type":["Person"],"name":"A"}', '{"@type":"Person","name":{"x":1},"email":"e@x.io"}',
               '{"@type":"Organization","name":"Org A","telephone":5551234}']
    html = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
    got = {(r.type, r.value) for r in S.jsonld(parse_pages(pages_of(html))).collect()}
    assert got == {("email", "e@x.io"), ("name", "Org A"), ("phone", "5551234")}


def test_meta_and_contact_elements(spark, pages_of):
    html = ('<meta name="Keywords" content="k1"><meta name="description" content="d1"><meta name="x" content="no">'
            '<span class="a contact">c1</span><div id="my-contact-box">c2</div><p class="contacts">no</p>')
    p = parse_pages(pages_of(html))
    assert [r.content for r in S.meta_contents(p).orderBy("node_id").collect()] == ["k1", "d1"]
    assert [r.text for r in S.contact_elements(p).orderBy("node_id").collect()] == ["c1", "c2"]


def test_parsed_pages_written_once_equals_persisted(spark, pages_of):
    from conftest import FB
    from sitesift.plans.contact import contact_info, parsed_pages
    pages = pages_of(FB)
    a = {tuple(r) for r in contact_info(pages, fuzzy=False, parsed=parsed_pages(pages)).collect()}
    b = {tuple(r) for r in contact_info(pages, fuzzy=False, parsed=parsed_pages(pages, keep=True)).collect()}
    assert a == b and a


def test_jsonld_duplicate_keys_and_problems(spark, pages_of):
    from sitesift.operators.htmltree import parse_pages
    from sitesift.operators.structure import jsonld, jsonld_problems
    script = '<script type="application/ld+json">%s</script>'
    pages = pages_of(script % '{"@type":"Person","name":"A","name":"B","email":"a@b.co"}', script % "{bad" + script % "[]")
    p = parse_pages(pages)
    assert {(r.type, r.value) for r in jsonld(p).collect()} == {("name", "B"), ("email", "a@b.co")}
    assert [(r.page_id, r.level) for r in jsonld_problems(p).collect()] == [(2, "warning")]


def test_one_pass_equals_the_mention_rows(spark, pages_of):
    from conftest import FA, FB, FB_TITLES
    from sitesift.operators.aggregate import distinct_mentions, sort_by_relevance
    from sitesift.plans.contact import contact_info, contextual_mentions, parsed_pages, wrapper_info, wrapper_mentions
    p = parsed_pages(pages_of(FA, FB, "", None), keep=True)
    for kw in ({"titles": FB_TITLES}, {"titles": [], "fuzzy": False}, {"phones_everywhere": True, "linkedin": False}):
        rows = distinct_mentions(contextual_mentions(p, **kw)).collect()
        assert sorted(map(tuple, contact_info(None, parsed=p, **kw).collect())) == sorted(map(tuple, rows))
    rows = sort_by_relevance(wrapper_mentions(p), keys=("page_id", "url")).select("page_id", "url", "type", "value", "rn")
    got = wrapper_info(None, parsed=p).select("page_id", "url", "type", "value", "rn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_any_input_gives_a_row(spark):
    """Tag soup of every kind: no input stops the others, trees stay consistent."""
    import random

    from sitesift.operators.htmltree import parse_or_error, parse_pages, parse_problems

    rng = random.Random(11)
    bits = ["<", ">", "</", "<p", "<p>", "</p>", "<![", "<![CDATA[", "]]>", "<!--", "-->", "<!", "<?", "?>", "<a href=", "'", '"', "=", "&", "&#x", "&lt;", "x", " ",
            "<script>", "</script>", "<textarea>", "\x00", "퟿", "é", "foo[", "<br/>", "</", "<pre>\n", "<style", "\n", "if", "temp"]
    pages = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(3000)]
    refused = 0
    for html in pages:
        text, elements, nodes, error = parse_or_error(html)
        refused += error is not None
        for e in elements:
            assert e["parent_id"] < e["node_id"] <= e["last_desc"] < len(elements) and 0 <= e["text_start"] <= e["text_end"] <= len(text)
        assert error is None or not (text or elements or nodes)
    assert 0 < refused < len(pages)
    rows = [(k, f"http://a/{k}", h) for k, h in enumerate([*pages[:500], None, "", "<p>ok</p>", "<p>a<![foo[x]]>b</p>"])]
    parsed = parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()
    assert parsed.count() == len(rows)
    got = {r["page_id"]: r for r in parsed.collect()}
    assert got[502]["text"] == "ok" and got[502]["error"] is None and got[503]["error"].startswith("AssertionError")
    assert {r["page_id"] for r in parse_problems(parsed).collect()} == {k for k, r in got.items() if r["error"]}
    parsed.unpersist()


def test_hostile_pages_are_linear():
    import time

    from sitesift.operators.htmltree import parse_or_error

    n = 60_000
    pages = ["<div>" * n + "</p>" * n, "<a " * n, "<!--" * n, "<!-- >" * n, "<![CDATA[" * n, "<![CDATA[ >" * n, "<a b='" * n, "<!" * n, "</a " * n,
             "<script>" + "</" * n, "&#x" * n, "<" * n, '<a ">' * n]
    start = time.time()
    for html in pages:
        parse_or_error(html)
    assert time.time() - start < 20      # a quadratic one alone takes minutes
    # openings without their closing sign stay text, in scripts they stay as they are
    assert parse_or_error("a <b x='1")[0] == "a <b x='1" and parse_or_error("<p>x &amp; <!-- y")[0] == "x & <!-- y"
    assert parse_or_error("<script>if (a < b) &amp;")[1][0]["raw_text"] == "if (a < b) &amp;"


def test_plain_tags_skip_the_tokenizers_slow_path(monkeypatch):
    from html.parser import HTMLParser

    from sitesift.operators.htmltree import parse_html
    slow = []
    for name in ("parse_starttag", "parse_endtag", "updatepos"):
        real = getattr(HTMLParser, name)
        monkeypatch.setattr(HTMLParser, name, lambda self, *a, _real=real, _name=name: slow.append(_name) or _real(self, *a))
    text, els, _ = parse_html('<DIV Class="a &amp; b" id="x"><p>hi</P><script type="t">a<b></script></DIV>')
    assert (text, [e["tag"] for e in els], els[0]["attrs"], els[2]["raw_text"]) == (
        "hi", ["div", "p", "script"], [("class", "a & b"), ("id", "x")], "a<b>")
    assert slow == ["parse_endtag"]       # only the end of the script
    odd = parse_html("<a href=x>1</a ><a b='c>d' b=\"e\"f>2</a><br/>")
    assert [e["attrs"] for e in odd[1]] == [[("href", "x")], [("b", "e"), ("f", "")], []] and "parse_starttag" in slow


def test_mentions_of_a_page_are_found_in_one_parse(spark):
    from sitesift.operators.htmltree import parse_pages
    from sitesift.plans.contact import contextual_mentions, wrapper_mentions
    page = ('<div class="team staff">Ana Lopez, Project Manager, a@b.example.com</div><h2>Our people</h2><p>Bo Diaz Lead</p>'
            '<a href="mailto:x@y.example.com">Write to Ana Lopez now</a><a href="https://www.linkedin.com/in/ana">in</a>'
            '<meta name="keywords" content="CEO Office"><p class="contact">Call Ana Lopez</p>')
    pages = spark.createDataFrame([(1, "http://a", page), (2, "http://b", None)], "page_id long, url string, html string")
    found = contextual_mentions(parse_pages(pages))
    wrapped = wrapper_mentions(parse_pages(pages))
    for df in (found, wrapped):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = [tuple(r) for r in found.collect()]
    # one row for each keyword that tells the block, as the exploded blocks give
    assert rows.count((1, "http://a", "context", "email", "a@b.example.com", "high", None)) == 2
    assert (1, "http://a", "context", "name", "Bo Diaz Lead", "high", None) in rows
    assert (1, "http://a", "meta", "title", "CEO", None, None) in rows
    assert (1, "http://a", "link", "name", "Ana Lopez", None, None) in rows
    assert (1, "http://a", "mailto", "email", "x@y.example.com", None, 1.0) in rows
    assert (1, "http://a", "linkedin", "linkedin", "https://www.linkedin.com/in/ana", None, None) in rows
    assert {r[0] for r in rows} == {1}
    assert (1, "http://a", "contact", "name", "Call Ana Lopez") in [tuple(r) for r in wrapped.collect()]


def test_plain_stretches_are_read_by_one_pattern(monkeypatch):
    """Whole stretches of plain tags and texts are one step; the tree is that of the tokenizer alone."""
    import random

    from sitesift.operators import htmltree
    steps, builder = [], htmltree._TreeBuilder
    monkeypatch.setattr(builder, "updatepos", lambda self, i, j: steps.append(j) or j)
    text, els, nodes = htmltree.parse_html('<p>a &amp; b</p>' * 50 + "<br>end</p>")
    assert (text, len(els), len(nodes)) == ("a & b" * 50 + "end", 51, 51) and len(steps) <= 4

    rng = random.Random(5)
    bits = ["<p>", "</p>", "<B Class=\"a &amp; b\" class=\"c\">", "</b>", "</B >", "<a\nhref=\"x\"\tid=\"y\">", "<a href=x>", "</a>", "<br>", "<br/>", "</br>",
            "<script>", "</script>", "<STYLE>", "</Style>", "<pre>", "</pre>", "<title>", "</title>", "<!-- c -->", "<!--", "<![CDATA[x]]>", "<?pi>", "<!DOCTYPE html>",
            "&amp;", "&#65;", "&lt", "&x", "a", " ", "\n", "\u00e9", "<", ">", "</", "</>", "\"", "'", "<a b=\"", "<x:y>", "<img src=\"q\"alt=\"z\">", "\r"]
    pages = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(3000)]
    fast = [htmltree.parse_or_error(h) for h in pages]
    monkeypatch.setattr(builder, "_plain", lambda self, i: i)
    assert fast == [htmltree.parse_or_error(h) for h in pages]
