import html
import re

from faultline.llm import maintext


def article_text(page):
    """Blocks of the article element, by splitting at block tags."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div|li|ul)\b[^>]*>", inner)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_query_over_the_whole_table(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = maintext.op4_boosted_nodes(spark, small).collect()
    assert len(got) == len(pages)
    right = [r.text == article_text(pages[r.page_id]) for r in got]
    print("right", sum(right), len(right))
    assert sum(right) >= 0.98 * len(right)
    assert all(r.n_chars == len(r.text) for r in got)


def test_other_layouts_and_odd_pages(spark, small):
    body = "".join(f"<p>Sentence one of block {i}, with words. And another one follows here, as prose does.</p>" for i in range(6))
    page = (
        "<html><head><title>t</title></head><body><header><a href='/'>Home</a></header><ul class='menu'><li><a href=a>A</a><li><a>B</a></ul>"
        f"<div class=\"cookie-notice\">We use cookies.</div><div id='content'><h1>A &amp; B</h1>{body}"
        "<div class='comments'><p>Nice post, thank you.</p></div></div><aside><p>Read more</p></aside>"
        "<form>Mail <input name=x> <button>Send</button></form><script>var a = '<p>x</p>';</script></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (4, "u", "<p>open <b>text"), (5, "u", "plain & text"), (6, "u", "<"), (1, "u", page)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    model = maintext.fit(spark.read.parquet(f"{small}/pages.parquet"))
    got = maintext.extract(d, model).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    text = by_id[1].text
    print(text)
    assert text.startswith("A & B\nSentence one of block 0") and "block 5" in text
    assert not any(w in text for w in ("cookies", "Home", "Nice post", "Read more", "Send", "var a"))
    assert by_id[2].text == "" and by_id[None].text == "" and by_id[2].n_chars == 0
    assert maintext.extract(d.limit(0), None).count() == 0
    assert maintext.fit(d.limit(0)) is None


def test_sibling_place_means_the_same_for_any_number_of_siblings():
    """The place of a child among its siblings runs evenly from 0 to 1, at 49 siblings as at 50 and at many."""
    for n in (2, 49, 50, 3000):
        page = "<div>" + "".join(f"<p>Block {i}.</p>" for i in range(n)) + "</div>"
        order = maintext.nodes_of(maintext.parse(page))
        rows = maintext.features(order)
        got = [float(r[5]) for node, r in zip(order, rows) if node.tag == "p"]
        assert len(got) == n and all(abs(g - i / n) < 1e-6 for i, g in enumerate(got))
