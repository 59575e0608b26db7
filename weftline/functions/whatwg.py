"""An exact URL parser (the browsers' algorithm for the usual schemes) and its Arrow UDFs."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPECIAL = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443", "file": ""}
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
_PATH_SET = set(' "#<>?`{}^')
_QUERY_SET = set(" \"#<>'")
_FRAGMENT_SET = set(' "<>`')
_USER_SET = _PATH_SET | set("/:;=@[\\]|")
_FORBIDDEN = set("\0\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(i) for i in range(0x20)}


@dataclass(frozen=True)
class Url:
    scheme: str
    username: str
    password: str
    host: str | None
    port: str
    path: str
    search: str
    hash: str

    @property
    def href(self) -> str:
        if self.host is None:
            return f"{self.scheme}:{self.path}{self.search}{self.hash}"
        user = f"{self.username}{':' + self.password if self.password else ''}@" if self.username or self.password else ""
        return f"{self.scheme}://{user}{self.host}{':' + self.port if self.port else ''}{self.path}{self.search}{self.hash}"

    @property
    def origin(self) -> str:
        return "null" if self.host is None or self.scheme == "file" else f"{self.scheme}://{self.host}{':' + self.port if self.port else ''}"


def _encode(text: str, unsafe: set[str]) -> str:
    return "".join(c if " " <= c <= "~" and c not in unsafe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ipv4(host: str) -> str | None:
    """The dotted form of a host whose last label is a number; ValueError if it isn't a valid address."""
    labels = host.rstrip(".").split(".")
    if not re.fullmatch(r"[0-9]+|0[xX][0-9A-Fa-f]*", labels[-1]):
        return None
    if len(labels) > 4:
        raise ValueError("invalid host")
    numbers = []
    for x in labels:
        if re.fullmatch(r"0[xX][0-9A-Fa-f]*", x):
            numbers.append(int(x[2:] or "0", 16))
        elif re.fullmatch(r"0[0-7]*", x):
            numbers.append(int(x, 8))
        elif re.fullmatch(r"[1-9][0-9]*", x):
            numbers.append(int(x))
        else:
            raise ValueError("invalid host")
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError("invalid host")
    value = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def parse_host(host: str, special: bool) -> str:
    if host.startswith("["):
        if not host.endswith("]"):
            raise ValueError("invalid host")
        return f"[{ipaddress.IPv6Address(host[1:-1]).compressed}]"
    if not special:
        if any(c in _FORBIDDEN - {"%"} for c in host):
            raise ValueError("invalid host")
        return _encode(host, set())
    name = unquote_to_bytes(host).decode("utf-8", "replace")
    if name.isascii():
        name = name.lower()
    else:
        try:
            import idna

            name = idna.encode(name, uts46=True, transitional=False).decode("ascii")
        except ImportError:
            name = name.encode("idna").decode("ascii")
        except Exception as e:
            raise ValueError("invalid host") from e
    if not name or any(c in _FORBIDDEN for c in name):
        raise ValueError("invalid host")
    return _ipv4(name) or name


def _segments(path: str, special: bool) -> list[str]:
    return re.split(r"[/\\]" if special else "/", path)


def _normal_path(segments: list[str]) -> str:
    out: list[str] = []
    for i, s in enumerate(segments):
        low, last = s.lower().replace("%2e", "."), i == len(segments) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(s, _PATH_SET))
    return "/" + "/".join(out)


def parse(text: str, base: str | Url | None = None) -> Url:
    """The parsed URL; ValueError if there is none."""
    if isinstance(base, str):
        base = parse(base)
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    rest, _, hash_ = text.partition("#")
    hash_ = "#" + _encode(hash_, _FRAGMENT_SET) if hash_ else ""
    m = _SCHEME.match(rest)
    scheme = m[1].lower() if m else None
    if m and base is not None and scheme in SPECIAL and scheme == base.scheme and not re.match(r"[/\\]", rest[m.end() :]):
        rest, m = rest[m.end() :], None  # "http:path" is relative to a base of the same scheme
    if m is None:
        if base is None:
            raise ValueError("invalid URL: no scheme and no base")
        scheme = base.scheme
    else:
        rest = rest[m.end() :]
    special = scheme in SPECIAL
    body, mark, query = rest.partition("?")
    search = "?" + _encode(query, _QUERY_SET if special else _QUERY_SET - {"'"}) if query else ""
    slashes = re.match(r"[/\\]*" if special else r"/*", body)[0]
    if m is not None and scheme == "file":
        if len(slashes) >= 2:
            host, _, path = body[2:].replace("\\", "/").partition("/")
            host = "" if host.lower() == "localhost" or not host else parse_host(host, True)
            return Url("file", "", "", host, "", _normal_path(_segments(path, True)), search, hash_)
        return Url("file", "", "", "", "", _normal_path(_segments(body.lstrip("/\\"), True)), search, hash_)
    if (m is not None and (special or len(slashes) >= 2)) or (m is None and len(slashes) >= 2):
        after = body[len(slashes) :] if special else body[2:]
        if scheme == "file":
            after = body[2:]
        end = re.search(r"[/\\]" if special else "/", after)
        authority, path = (after[: end.start()], after[end.start() :]) if end else (after, "")
        user, at, hostport = authority.rpartition("@")
        username, _, password = user.partition(":")
        hp = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", hostport)
        if not hp or (special and not hp[1]):
            raise ValueError("invalid URL: host or port")
        port = hp[2] or ""
        if port:
            if int(port) > 65535:
                raise ValueError("invalid URL: port")
            port = str(int(port))
        if port == SPECIAL.get(scheme):
            port = ""
        host = parse_host(hp[1], special) if hp[1] else ""
        full = _normal_path(_segments(path[1:], special)) if path else ("/" if special else "")
        return Url(scheme, _encode(username, _USER_SET), _encode(password, _USER_SET), host, port, full, search, hash_)
    if m is not None:
        if slashes:
            return Url(scheme, "", "", None, "", _normal_path(_segments(body[1:], False)), search, hash_)
        return Url(scheme, "", "", None, "", _encode(body, set()), search, hash_)
    if base.host is None:
        if text.startswith("#") and not rest:
            return Url(base.scheme, "", "", None, "", base.path, base.search, hash_)
        raise ValueError("invalid URL: the base has no host")
    keep = (base.scheme, base.username, base.password, base.host, base.port)
    if not body:
        return Url(*keep, base.path, search if mark else base.search, hash_)
    if slashes:
        return Url(*keep, _normal_path(_segments(body[1:], special)), search, hash_)
    return Url(*keep, _normal_path([*base.path[1:].split("/")[:-1], *_segments(body, special)]), search, hash_)


def try_parse(text: str | None, base: str | None = None) -> Url | None:
    try:
        return parse(text, base) if text is not None else None
    except ValueError:
        return None


_FIELDS = ("href", "scheme", "username", "password", "host", "port", "path", "search", "hash", "origin")
_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in _FIELDS])


def _row(u: Url | None) -> tuple:
    return (None,) * 10 if u is None else (u.href, u.scheme, u.username, u.password, u.host, u.port, u.path, u.search, u.hash, u.origin)


@F.pandas_udf(_SCHEMA)
def whatwg_parse(url: pd.Series) -> pd.DataFrame:
    """A struct of the parts; all null if the URL can't be parsed."""
    return pd.DataFrame([_row(try_parse(x)) for x in url], columns=list(_FIELDS), dtype=object)


@F.pandas_udf(T.StringType())
def whatwg_resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """The link's absolute form, or null."""
    out, bases = [], {}
    for b, h in zip(base, href):
        if b not in bases:
            bases[b] = try_parse(b)
        try:
            out.append(parse(h, bases[b]).href if h is not None else None)
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def punycode_host(host: pd.Series) -> pd.Series:
    """A host in its ASCII form; hosts that have none come back as they are."""

    def one(h: str | None) -> str | None:
        try:
            return parse_host(h, True) if h else h
        except ValueError:
            return h

    return pd.Series([one(h) for h in host], dtype=object)
