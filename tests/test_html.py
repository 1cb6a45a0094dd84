"""Element rows and key/value look-ups."""

from __future__ import annotations

import random

import pytest

from tickloom.operators import html as H

TABLE = """<!DOCTYPE html><html><head><meta charset="utf-8"><link rel="x"><title>T</title></head>
<body class="A" ID="b"><img src="i.png"><input value="v"><br>
<div><table><tr><td>spark.app.id</td><td>app-1</td></tr>
<tr><td> key
 two </td><td>a &amp; b</td></tr>
<tr><td>empty</td><td></td></tr>
<tr><td>lonely</td></tr>
<tr><td><b>spark.app.id</b><i>nested</i></td></tr>
<tr><td>before</td><td>after-key</td><td>more</td></tr></table></div></body></html>"""


def elements(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    return H.html_elements(df)


def tree(spark, page):
    rows = sorted(elements(spark, page).collect(), key=lambda r: r.elem_id)
    return [(r.elem_id, r.parent_id, r.depth, r.tag, r.data) for r in rows], rows


def test_element_rows(spark):
    flat, rows = tree(spark, "<div A=1 a=2><p>one<b>two</b>\n three\n</p> </div>tail<p>x</p>")
    assert flat == [(0, None, 0, "div", ""), (1, 0, 1, "p", "three"), (2, 1, 2, "b", "two"), (3, None, 0, "p", "x")]
    assert rows[0].attributes == {"a": "2"} and all(r.balanced for r in rows)


def test_skipped_and_childless_tags(spark):
    flat, rows = tree(spark, TABLE)
    tags = [t[3] for t in flat]
    assert not set(tags) & H.SKIPPED_TAGS
    # an image opens nothing: what follows is its sibling
    assert [t[1] for t in flat if t[3] in ("img", "input", "div")] == [flat[tags.index("body")][0]] * 3
    assert rows[tags.index("body")].attributes == {"class": "A", "id": "b"}
    assert rows[0].balanced


def test_end_tag_closes_only_the_innermost(spark):
    flat, rows = tree(spark, "<a><b>x</a>y</b>z")
    assert flat == [(0, None, 0, "a", "z"), (1, 0, 1, "b", "y")]
    assert not rows[0].balanced


def test_entities_split_text(spark):
    flat, _ = tree(spark, "<p>a &amp; b</p><p>&lt;</p><p>a&#65;</p>")
    assert [t[4] for t in flat] == ["b", None, "a"]


def test_scripts_comments_and_broken_pages(spark):
    flat, _ = tree(spark, "<script>if (a < b) { '<p>' }</script><!-- <p> --><p>x<")
    assert [(t[3], t[4]) for t in flat] == [("script", "if (a < b) { '<p>' }"), ("p", "x")]
    assert elements(spark, "", "no tags", None).count() == 0


def test_many_pages_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(H, "_ROWS_PER_BATCH", 5)
    pages = ["<p>%d</p>" % i * (i % 7) for i in range(60)]
    rows = elements(spark, *pages).collect()
    assert len(rows) == sum(i % 7 for i in range(60))
    assert all(r.data == str(r.page_id) for r in rows)


@pytest.mark.parametrize("key, value", [
    ("spark.app.id", "app-1"), ("key two", "b"), ("empty", None), ("after-key", "before"), ("nested", "spark.app.id"),
])
def test_value_beside_key(spark, key, value):
    rows = H.html_value_for(elements(spark, TABLE), key).collect()
    assert [(r.page_id, r.value) for r in rows] == [(0, value)]


def test_missing_and_lonely_keys(spark):
    page = elements(spark, TABLE)
    assert H.html_value_for(page, "no such key").count() == 0
    assert [r.value for r in H.html_value_for(page, "lonely").collect()] == [None]
    assert H.html_value_for(elements(spark, "<p>root</p><p>other</p>"), "root").count() == 0


def test_parent_comes_before_its_descendants(spark):
    page = "<div><ul><li>k</li><li>inner</li></ul><p>k</p><p>outer</p></div>"
    # the list (which has data NULL) is the outer element's first child of another text
    assert [r.value for r in H.html_value_for(elements(spark, page), "k").collect()] == [None]


def test_several_keys_at_once(spark):
    found = H.html_values_for(elements(spark, TABLE), {"a": "spark.app.id", "b": "before", "c": "none"})
    assert [r.asDict() for r in found.collect()] == [{"page_id": 0, "a": "app-1", "b": "after-key", "c": None}]


def test_links(spark):
    page = "<table><tr><td>spark.app.id</td><td>a1</td></tr><tr><td>my.job</td><td>7</td></tr></table>"
    pages = spark.createDataFrame(
        [("a1", page), ("a2", page), ("a3", "<p></p>"), ("a4", None)], "app_id string, html string")
    apps = spark.createDataFrame(
        [("a1", False), ("a2", True), ("a3", False), ("a4", False), ("a5", False), ("a1", False)],
        "app_id string, completed boolean")
    links = H.link_apps_to_jobs(apps, pages, job_key="my.job").collect()
    assert sorted(tuple(r) for r in links) == [("a1", "a1", "7"), ("a3", None, None)]


def test_values_where_pages_are_parsed(spark):
    """The same as from element rows, and a row for pages without the keys."""
    cell = lambda *texts: "<tr>" + "".join(f"<td>{t}</td>" if t is not None else "<td></td>" for t in texts) + "</tr>"
    pages = [
        (1, "<table>" + cell("k", "v") + cell("k", "w") + cell("j", "x", "y") + "</table>"), (2, "<table>" + cell("v", "k") + "</table>"),
        (3, "<table>" + cell("k", "k") + cell("k", "z") + "</table>"), (4, "<table>" + cell("k", None, "z") + "</table>"), (5, "<p>k</p>"), (6, ""), (7, None),
        (8, "<div>k<p>k</p><b>late</b></div><table>" + cell(" j ", "1") + "</table>")]
    df = spark.createDataFrame(pages, "page_id bigint, html string")
    keys = {"a": "k", "b": "j"}
    want = sorted(tuple(r) for r in H.html_values_for(H.html_elements(df), keys).collect())
    got = H.page_values(df, keys).collect()
    assert sorted(tuple(r)[:3] for r in got if r.found) == want and len(want) >= 5
    assert sorted(r.page_id for r in got) == [1, 2, 3, 4, 5, 6, 8]
    cells = H.html_elements(df, tags=("td",)).collect()
    assert {r.tag for r in cells} == {"td"} and len(cells) == H.html_elements(df).filter("tag = 'td'").count()


def test_plain_pages_are_read_as_the_parser_reads_them():
    """Pages of plain tags take the short way, all others the parser's."""

    def parsed(page):
        parser = H._Elements()
        parser.feed(page)
        return parser.rows, not parser.open

    plain = ["", "no tags", " x<p>one", "<!DOCTYPE html>\n<HTML><body class=a ID='b c' hidden a=1 a=\"2\"><img src=i.png>text<br>more</body ></html>tail",
             "<a><b>x</a>y</b>z", "<td>\n key\x0b\n two </td><td></td>", "<p\n><h1>é</h1>"]
    other = ["<p>a &amp; b</p>", "<script>if (a < b) { '<p>' }</script>", "<!-- <p> --><p>x", "<p>x<", "<i/>", "</b x>", "<b a = 1>", "<title>T</title>", "<p class='>'>", "<u a=\"1\"b>"]
    for page in plain:
        assert H._plain_elements(page) == parsed(page)
    for page in other:
        assert H._plain_elements(page) is None and H._page_elements(page) == parsed(page)


def test_pages_of_one_shape_are_worked_out_once(monkeypatch):
    """Texts may differ, be blank or missing, or hold signs of tags."""
    made, shape = [], H._plain_shape
    monkeypatch.setattr(H, "_plain_shape", lambda *a: made.append(a) or shape(*a))
    page = "{0}<!doctype html>{1}<table><tr>{2}<td>{3}</td>{0}<td a='{4}'>{1}<br>{2}</td></tr>{4}</table>{3}"
    texts = ["", " ", "\n", "a", " b\nc ", "d > e", "/td", "x='", "é"]
    pages, draw = H._Pages(), random.Random(3)
    for _ in range(300):
        html = page.format(*draw.choices(texts, k=4), "k")
        parser = H._Elements()
        parser.feed(html)
        found = pages.read(html)
        assert (H._elements(*found), found[0].balanced) == (parser.rows, not parser.open)
    assert len(made) == 1


def test_only_the_columns_asked_for_are_sent(spark):
    df = spark.createDataFrame([(1, "<p>a<b x=1>c</b></p>"), (2, "<p>&amp;<b>d</b>"), (3, None)], "page_id int, html string")
    whole, part = H.html_elements(df, tags=("b",)), H.html_elements(df, tags=("b",), columns=("data", "page_id", "elem_id"))
    assert part.columns == ["data", "page_id", "elem_id"]
    assert sorted(part.collect()) == sorted(whole.select(part.columns).collect()) == [("c", 1, 1), ("d", 2, 1)]
