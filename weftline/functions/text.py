"""Regex, JSON and schema helpers as Columns. Patterns are literals in the subset that Java and RE2 share."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAIL = r"^[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
WEB_URL = r"^https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_META = re.compile(r"([.*+?^${}()|\[\]\\])")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def check_pattern(pattern: str) -> str:
    """The pattern itself; ValueError if it can't be compiled or goes beyond the common subset."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid regular expression {pattern!r}: {e}") from e
    if re.search(r"\(\?[=!<](?![A-Za-z])|\\[1-9]", pattern):
        raise ValueError(f"lookaround and back references aren't in the common subset: {pattern!r}")
    return pattern


def is_valid_pattern(pattern: str) -> bool:
    try:
        check_pattern(pattern)
    except ValueError:
        return False
    return True


def test(pattern: str, text: Column | str) -> Column:
    return _c(text).rlike(check_pattern(pattern))


def find_all(pattern: str, text: Column | str) -> Column:
    """All matches, as an array."""
    return F.regexp_extract_all(_c(text), F.lit(check_pattern(pattern)), F.lit(0))


def find_first(pattern: str, text: Column | str) -> Column:
    """The first match, or null."""
    return F.regexp_substr(_c(text), F.lit(check_pattern(pattern)))


def find_first_index(pattern: str, text: Column | str) -> Column:
    """Its 0-based place, or null."""
    at = F.regexp_instr(_c(text), F.lit(check_pattern(pattern)))
    return F.when(at > 0, at - 1)


def count(pattern: str, text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(check_pattern(pattern)))


def replace_all(pattern: str, text: Column | str, new: str) -> Column:
    """``new`` is literal: $ and backslash have no meaning in it."""
    return F.regexp_replace(_c(text), check_pattern(pattern), new.replace("\\", "\\\\").replace("$", "\\$"))


def replace_first(pattern: str, text: Column | str, new: str) -> Column:
    text = _c(text)
    at = F.regexp_instr(text, F.lit(check_pattern(pattern)))
    found = F.regexp_substr(text, F.lit(pattern))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + F.length(found), F.length(text)))).otherwise(text)


def split(pattern: str, text: Column | str, limit: int | None = None) -> Column:
    """At most ``limit`` pieces; what follows them is dropped."""
    out = F.split(_c(text), check_pattern(pattern), -1)
    return out if limit is None else F.slice(out, 1, limit)


def escape(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_literal(text: str) -> str:
    return _META.sub(r"\\\1", text)


def extract_groups(pattern: str, text: Column | str) -> Column:
    """The groups of the first match, or null."""
    n = re.compile(check_pattern(pattern)).groups
    return F.when(_c(text).rlike(pattern), F.array(*[F.regexp_extract(_c(text), pattern, k) for k in range(1, n + 1)]))


def extract_all_groups(pattern: str, text: Column | str) -> Column:
    """The groups of every match, as an array of arrays."""
    n = re.compile(check_pattern(pattern)).groups
    columns = [F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(k)) for k in range(1, n + 1)]
    return F.transform(columns[0], lambda x, i: F.array(x, *[F.get(c, i) for c in columns[1:]]))


def from_glob(glob: str) -> str:
    """An anchored pattern in which * is anything and ? is one character."""
    body = re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", glob).replace("*", ".*").replace("?", ".")
    return f"^{body}$"


def starts_with(pattern: str, text: Column | str) -> Column:
    return test(f"^{pattern}", text)


def ends_with(pattern: str, text: Column | str) -> Column:
    return test(f"{pattern}$", text)


def case_insensitive(pattern: str) -> str:
    return f"(?i){pattern}"


def is_email(text: Column | str) -> Column:
    return _c(text).rlike(EMAIL)


def is_url(text: Column | str) -> Column:
    return _c(text).rlike(WEB_URL)


# ---- JSON


def json_parse(text: Column | str, schema: str | T.StructType | None = None) -> Column:
    """With a schema a typed value, else VARIANT; null if the text isn't JSON."""
    return F.try_parse_json(_c(text)) if schema is None else F.from_json(_c(text), schema)


def json_is_valid(text: Column | str) -> Column:
    return F.try_parse_json(_c(text)).isNotNull()


def json_or_default(text: Column | str, schema: str | T.StructType, default: Column) -> Column:
    return F.coalesce(F.from_json(_c(text), schema), default)


def json_stringify(value: Column | str, pretty: bool = False) -> Column:
    return F.to_json(_c(value), {"pretty": "true"} if pretty else {})


def json_get(text: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a path such as $.a.b[0], or null."""
    return F.try_variant_get(F.try_parse_json(_c(text)), path, kind)


def map_merge(*maps: Column) -> Column:
    """Of equal keys the last map's value wins."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(F.map_filter(out, lambda k, v: ~F.map_contains_key(m, k)), m)
    return out


def map_pick(m: Column | str, keys: Sequence[str]) -> Column:
    return F.map_filter(_c(m), lambda k, v: k.isin(list(keys)))


def map_omit(m: Column | str, keys: Sequence[str]) -> Column:
    return F.map_filter(_c(m), lambda k, v: ~k.isin(list(keys)))


# ---- schemas and validation


def merge_schemas(*schemas: T.StructType) -> T.StructType:
    """Of equal names the last field wins, at the first one's place."""
    fields: dict[str, T.StructField] = {}
    for s in schemas:
        for f in s.fields:
            fields[f.name] = f
    return T.StructType(list(fields.values()))


def optional(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])


def array_of(schema: T.DataType) -> T.ArrayType:
    return T.ArrayType(schema)


def record_of(schema: T.DataType) -> T.MapType:
    return T.MapType(T.StringType(), schema)


def validate(rules: Mapping[str, Column]) -> Column:
    """The messages of the rules that don't hold (null counts as not holding), as an array."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules.items()]))
