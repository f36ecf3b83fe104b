"""Configured page attributes on small pages."""

import pytest

from cairn.sources.pages import Attribute, extract_attributes, parse_step

PAGE = """<html lang=en><head><title> A  new&amp;old day </title><meta name="keywords" content=" New, old ,,Day">
<style>h1 > b { }</style><script>var x = "<h1>no</h1>";</script></head><body class="wide news"><div id=top><p>lead<br>line</div>
<h1>One <b>bold</b></h1></i><section><h1 class="x y">Two</h1><ul><li>A new<li>old day</ul></section><p class=empty>  </p>"""


def rows(spark, attributes, pages=((1, "http://h/p?q", PAGE), (2, "http://h/", ""), (3, "x", None)), **more):
    ok, failed = extract_attributes(spark.createDataFrame(list(pages), "page_id int, url string, html string"), attributes, **more)
    return {r.page_id: r for r in ok.collect()}, {r.page_id: r.failed for r in failed.collect()}


def test_selectors(spark):
    cases = {"title": "A new&old day", "h1": "One bold", "section h1": "Two", "h1.y.x": "Two", "body.news section *": "Two",
             "div#top p": "leadline", "html[lang=en] section li": "A newold day", "h2": None, "p.empty": None, "div h1": None,
             "script": 'var x = "<h1>no</h1>";', ".x .y": None}
    ok, _ = rows(spark, [Attribute(f"a{k}", s) for k, s in enumerate(cases)])
    got = {s: ok[1][f"a{k}"] for k, s in enumerate(cases)}
    assert got == cases
    assert all(ok[2][f"a{k}"] is None and ok[3][f"a{k}"] is None for k in range(len(cases)))


def test_defaults_required_tags(spark):
    config = [Attribute("title", "title", required=True), Attribute("by", ".byline", default="none", required=True),
              Attribute("word", "meta[name=keywords]", take="content", required=True)]
    ok, failed = rows(spark, config, tags=Attribute("t", "meta[name=keywords]", take="content"), title="title")
    assert list(ok) == [1] and failed == {2: "title,word", 3: "title,word"}
    assert (ok[1].by, ok[1].baseurl, ok[1].tags, ok[1].bigrams) == ("none", "http://h/p", ["new", "old", "day"], ["old day"])
    ok, _ = rows(spark, [Attribute("title", "title")], tags=Attribute("t", "li"))
    assert ok[1].tags == ["a newold day", "old day"] and ok[2].tags == [] == ok[3].tags


def test_bad_selector():
    with pytest.raises(ValueError):
        parse_step("a>b")
