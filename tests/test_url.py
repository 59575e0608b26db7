import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import url as U
from weftline.functions.whatwg import parse, try_parse

CASES = [
    ("HTTP://EXAMPLE.com:80/a/../b/./c?x=1#f", None, "http://example.com/b/c?x=1#f"),
    ("//x.y/z", "https://a.b/c", "https://x.y/z"),
    ("é d", "http://a.b/x/y?q", "http://a.b/x/%C3%A9%20d"),
    ("?z", "http://a.b/x/y?q", "http://a.b/x/y?z"),
    ("#f", "http://a.b/x/y?q", "http://a.b/x/y?q#f"),
    ("", "http://a.b/x/y?q#f", "http://a.b/x/y?q"),
    ("mailto:a@b", None, "mailto:a@b"),
    ("http://例え.jp/", None, "http://xn--r8jz45g.jp/"),
    ("http://[::1]:8080/", None, "http://[::1]:8080/"),
    ("http://0x7f.1/", None, "http://127.0.0.1/"),
    ("../../../k", "http://a.b/x/y", "http://a.b/k"),
    ("http:foo", "http://a.b/x/y", "http://a.b/x/foo"),
    ("https:\\\\a.b\\c", None, "https://a.b/c"),
    ("http://u:p@h.x:8080/", None, "http://u:p@h.x:8080/"),
    ("file:///etc/x", None, "file:///etc/x"),
    (" \thttps://a.b/x\n", None, "https://a.b/x"),
]


@pytest.mark.parametrize("text,base,want", CASES)
def test_whatwg(text, base, want):
    assert parse(text, base).href == want


@pytest.mark.parametrize("text", ["http://[invalid", "not-a-url", "http://a b/", "http://", "http://a:99999/", "http://1.2.3.4.5/", "//x"])
def test_whatwg_rejects(text):
    assert try_parse(text) is None


hosts = st.from_regex(r"[a-z]{1,8}(\.[a-z]{2,5}){1,2}", fullmatch=True).filter(lambda h: not h.rsplit(".", 1)[-1].startswith("0x"))
paths = st.lists(st.from_regex(r"[a-z0-9_-]{1,6}", fullmatch=True), max_size=4).map(lambda p: "/" + "/".join(p))
queries = st.lists(st.tuples(st.from_regex(r"[a-z]{1,3}", fullmatch=True), st.from_regex(r"[a-z0-9]{0,3}", fullmatch=True)), max_size=4)


@given(hosts, paths, queries)
@settings(max_examples=200, deadline=None)
def test_parsing_is_idempotent(host, path, query):
    text = f"https://{host}{path}" + ("?" + "&".join(f"{k}={v}" for k, v in query) if query else "")
    assert parse(parse(text).href).href == parse(text).href


def test_native_parts_agree_with_the_exact_parser(spark):
    """On well-formed ASCII URLs."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcxyz019-_") for _ in range(r.randint(1, 5)))
    urls = [f"{r.choice(['http', 'HTTPS', 'ftp'])}://{r.choice(['a.example', 'WWW.B.example', 'u:p@c.example:8080', 'd.example:80'])}/{'/'.join(word() for _ in range(r.randint(0, 3)))}{r.choice(['', '?', '?a=1&b=2'])}{r.choice(['', '#', '#t'])}" for _ in range(300)]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", U.parts("url").alias("p")).collect()
    for row in rows:
        e = parse(row["url"])
        p = row["p"]
        assert (p["scheme"], p["host"], p["port"], p["path"], p["search"], p["hash"]) == (e.scheme, e.host, e.port, e.path, e.search, e.hash), row["url"]


def test_normalisers_are_idempotent(spark):
    urls = ["https://Example.com:443/a//b/?z=1&a=2&z=0#top", "http://u@www.x.example/?", "https://x.example", "http://x.example/a/?b=&a"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for f in (U.normalise, U.dedup_key, U.normalize_url):
        once = df.select(f("url").alias("a"))
        assert once.where(~f("a").eqNullSafe(F.col("a"))).count() == 0


def test_strategy_is_checked():
    with pytest.raises(ValueError, match="www"):
        U.Strategy(www="sometimes")
