"""A small HTML tree on the standard tokenizer, a selector engine over it, and native helpers for tags.

The tree knows void and raw-text elements and the end tags that p, li, option, table parts and definition lists imply. It isn't a
full HTML5 builder: misnested formatting is closed at its parent, and no html, head, body or tbody is made up.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPES = frozenset("ul ol table select dl div body html button".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self):
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.open = [self.root]

    def _close(self, tags: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in _SCOPES:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES:
            self._close(_CLOSES[tag])
        elif tag in _BLOCKS:
            self._close({"p"})
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")  # the first of equal names counts
        parent = self.open[-1]
        node = Node(tag, given, parent)
        parent.children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# ---- selectors: tag, *, #id, .class, [attr], [attr op "value"], :first-child, :last-child, :nth-child(n), :not(simple); descendant, >, +, ~ and commas

_PART = re.compile(
    r"""\s*(?:(?P<comb>[>+~,])\s*|(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"""
    r"""|:(?P<pseudo>first-child|last-child|nth-child\(\s*(?P<n>\d+)\s*\)|not\((?P<neg>[^()]*)\)))"""
)


@lru_cache(maxsize=1024)
def compile_selector(selector: str) -> tuple:
    """((combinator, tests), ...) for each alternative; ValueError if it isn't in the supported subset."""
    groups, steps, tests, comb, at = [], [], [], " ", 0
    text = selector.strip()
    if not text:
        raise ValueError("empty selector")
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unsupported selector: {selector!r}")
        spaced = text[at : m.end()][:1].isspace()
        if m["comb"]:
            if not tests:
                raise ValueError(f"unsupported selector: {selector!r}")
            steps.append((comb, tuple(tests)))
            tests, comb = [], m["comb"]
            if comb == ",":
                groups.append(tuple(steps))
                steps, comb = [], " "
        else:
            if spaced and tests:
                steps.append((comb, tuple(tests)))
                tests, comb = [], " "
            if m["tag"]:
                tests.append(("tag", m["tag"].lower()))
            elif m["id"]:
                tests.append(("attr", "id", "=", m["id"]))
            elif m["cls"]:
                tests.append(("attr", "class", "~=", m["cls"]))
            elif m["attr"]:
                value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), None)
                tests.append(("attr", m["attr"].lower(), m["op"], value))
            elif m["neg"] is not None:
                tests.append(("not", compile_selector(m["neg"])))
            else:
                tests.append(("nth", {"first-child": 1, "last-child": -1}.get(m["pseudo"]) or int(m["n"])))
        at = m.end()
    if not tests:
        raise ValueError(f"unsupported selector: {selector!r}")
    steps.append((comb, tuple(tests)))
    return tuple([*groups, tuple(steps)])


def _siblings(n: Node) -> list[Node]:
    return [c for c in n.parent.children if isinstance(c, Node)] if n.parent else [n]


def _passes(n: Node, tests: tuple) -> bool:
    for t in tests:
        if t[0] == "tag":
            ok = t[1] in ("*", n.tag)
        elif t[0] == "not":
            ok = not any(matches(n, g) for g in t[1])
        elif t[0] == "nth":
            around = _siblings(n)
            k = t[1] - 1 if t[1] > 0 else len(around) + t[1]
            ok = 0 <= k < len(around) and around[k] is n
        else:
            _, name, op, value = t
            have = n.attrs.get(name)
            ok = have is not None and (
                op is None or (op == "=" and have == value) or (op == "~=" and value in have.split()) or (op == "^=" and bool(value) and have.startswith(value))
                or (op == "$=" and bool(value) and have.endswith(value)) or (op == "*=" and bool(value) and value in have) or (op == "|=" and (have == value or have.startswith(f"{value}-")))
            )
        if not ok:
            return False
    return True


def matches(n: Node, steps: tuple, k: int | None = None) -> bool:
    k = len(steps) - 1 if k is None else k
    if not _passes(n, steps[k][1]):
        return False
    if k == 0:
        return True
    comb = steps[k][0]
    if comb in "+~":
        around = _siblings(n)
        i = next(i for i, x in enumerate(around) if x is n)
        before = around[max(0, i - 1) : i] if comb == "+" else around[:i]
        return any(matches(x, steps, k - 1) for x in before)
    up = n.parent
    while up is not None and up.tag != "#document":
        if matches(up, steps, k - 1):
            return True
        if comb == ">":
            return False
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """The elements below ``root`` that match, in document order."""
    groups = compile_selector(selector)
    return [n for n in root.elements() if any(matches(n, g) for g in groups)]


# ---- native helpers: tags by pattern, after scripts, styles and comments are gone

_HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))


def visible(html: Column | str) -> Column:
    """The markup without comments, scripts and styles."""
    html = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(html, _HIDDEN, "")


def unescape(text: Column) -> Column:
    """The entities that the native path knows, ampersands last."""
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def tags(html: Column, tag: str) -> Column:
    """The start tags of this name, as an array."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))


def attribute(start_tag: Column, name: str) -> Column:
    """A quoted or bare attribute's value, unescaped; null if it isn't there."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(start_tag, pattern, k) for k in (1, 2, 3)])
    return F.when(start_tag.rlike(rf"(?is)\s{name}\s*="), unescape(value))


def title(html: Column | str) -> Column:
    """All titles' text, joined and not trimmed; null if there is none."""
    found = F.array_join(F.regexp_extract_all(visible(html), F.lit(r"(?is)<title\b[^>]*>(.*?)</title>"), F.lit(1)), "")
    return F.when(found != "", unescape(found))
