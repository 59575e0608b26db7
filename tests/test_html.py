import pytest

from weftline.functions import html as H
from weftline.operators.extract import check_config, extract

PAGE = """<html><head><title>A &amp; B</title></head><body><ul id="l"><li class="x first">1<li class="x">2</ul><p>one<p>two<div data-k="v-1"><a href="/a">in</a></div><a href="/b">out</a>
<script>var t = "<a href='/no'>"</script><!-- <a href="/no2"> --></body></html>"""


@pytest.mark.parametrize(
    "selector,n",
    [("a", 2), ("div > a", 1), ("div a, ul li", 3), ("li.x", 2), ("li:first-child", 1), ("li:nth-child(2)", 1), ("li:last-child", 1), ("#l li", 2), ("[data-k|=v]", 1), ('a[href^="/"]', 2), ("li + li", 1), ("p ~ div", 1), ("li:not(.first)", 1), ("*", 13), ("p", 2)],
)
def test_selectors(selector, n):
    assert len(H.select(H.parse(PAGE), selector)) == n


@pytest.mark.parametrize("selector", ["", "a >", "a:hover", "[", "a,,b", "> a"])
def test_bad_selectors(selector):
    with pytest.raises(ValueError):
        H.compile_selector(selector)


def test_fields():
    got = extract(PAGE, {
        "t": "title", "a": {"selector": "a", "attribute": "href"}, "e": {"selector": "table", "exists": True, "multiple": True}, "m": {"selector": "li", "multiple": True}, "none": "b",
        "ma": {"selector": "p", "multiple": True, "attribute": "id"}, "r": {"selector": "div", "multiple": True, "fields": {"x": "a", "y": {"selector": "a", "attribute": "href"}, "z": "i"}},
    })
    assert got == {"t": "A & B", "a": "/a", "e": False, "m": ["1", "2"], "ma": [None, None], "r": [{"x": "in", "y": "/a", "z": ""}]}


def test_config_is_checked():
    with pytest.raises(ValueError, match="one level"):
        check_config({"a": {"selector": "p", "multiple": True, "fields": {"b": {"selector": "i", "fields": {}}}}})
    with pytest.raises(ValueError, match="selector"):
        check_config({"a": {"attribute": "x"}})


def test_empty_and_broken_markup():
    for text in (None, "", "<", "<a", "</p></p>", "<p" * 50):
        H.parse(text)
