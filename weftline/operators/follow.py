"""Which links a crawl may follow, and why not: one CASE whose first failing rule gives the reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.text import check_pattern

#: Category -> (word in a reason, extensions)
EXTENSIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "archives": ("archive", tuple(sorted(".zip .xz .tar.gz .tar .rar .bz2 .7zip .7z".split()))),
    "images": ("image", tuple(sorted(".webp .tiff .tif .svg .pst .psp .ps .png .pct .mng .jpg .jpeg .ico .gif .eps .dxf .drw .cdr .bmp .ai".split()))),
    "audio": ("audio", tuple(sorted(".wma .wav .ra .ogg .mp3 .mid .au .aiff .aac".split()))),
    "video": ("video", tuple(sorted(".wmv .webm .swf .rm .qt .mpg .mp4 .mov .m4v .m4a .flv .avi .asx .asf .3gp".split()))),
    "office": ("office document", tuple(sorted(".xltx .xltm .xlsx .xlsm .xls .pptx .pptm .ppt .pps .potx .potm .odt .ods .odp .odg .dotx .dotm .docx .docm .docb .doc".split()))),
    "other": ("other file type", tuple(sorted(".sh .rss .rb .py .pdf .msp .msi .js .jar .iso .hta .exe .dmg .css .cpl .bin .bat .apk".split()))),
}


def skip_extensions(categories: Sequence[str] = tuple(EXTENSIONS)) -> list[str]:
    return [x for c in categories for x in EXTENSIONS[c][1]]


def extension_table(spark: SparkSession):
    """``category, label, extension``"""
    return spark.createDataFrame([(c, label, x) for c, (label, xs) in EXTENSIONS.items() for x in xs], "category string, label string, extension string")


@dataclass(frozen=True)
class FollowPolicy:
    allowed_protocols: tuple[str, ...] = ("http", "https", "file", "ftp")
    allowed_domains: tuple[str, ...] = ()
    blocked_domains: tuple[str, ...] = ()
    custom_filters: tuple[str, ...] = ()
    categories: tuple[str, ...] = tuple(EXTENSIONS)
    custom_extensions: tuple[str, ...] | None = None
    filter_malformed: bool = True
    filter_long: bool = True
    max_length: int = 2083
    filter_schemes: bool = True
    www: str = "ignore"  # ignore, preserve
    protocol: str = "permissive"  # permissive, strict
    subdomains: str = "preserve"  # ignore, preserve

    def __post_init__(self) -> None:
        for p in self.custom_filters:
            check_pattern(p)
        if unknown := set(self.categories) - set(EXTENSIONS):
            raise ValueError(f"unknown extension categories: {sorted(unknown)}")
        if self.max_length < 1:
            raise ValueError("max_length must be positive")


def _in_domain(host: Column, domains: Sequence[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith(f".{d}")
    return out


def extension_reason(url: Column | str, policy: FollowPolicy) -> Column:
    """The reason if the path ends with a skipped extension, else null."""
    p = F.lower(U.path(url))
    hit = lambda xs: F.coalesce(p.rlike(f"({'|'.join(x.lower().replace('.', chr(92) + '.') for x in xs)})$"), F.lit(False)) if xs else F.lit(False)
    skipped = policy.custom_extensions if policy.custom_extensions is not None else skip_extensions(policy.categories)
    if not skipped:
        return F.lit(None).cast("string")
    labels = F.array_join(F.array_compact(F.array(*[F.when(hit(EXTENSIONS[c][1]), EXTENSIONS[c][0]) for c in policy.categories])), "/") if policy.categories else F.lit("")
    return F.when(hit(skipped), F.when(labels != "", F.concat(F.lit("Filtered "), labels, F.lit(" file extension"))).otherwise("File extension not suitable for crawling"))


def follow_reason(url: Column | str, from_url: Column | None = None, start_url: Column | None = None, policy: FollowPolicy = FollowPolicy()) -> Column:
    """Null if the link may be followed, else the first rule that stops it.

    Opaque URLs (mailto:, javascript:) have a protocol and no host. Without an absolute form at all a link is malformed.
    """
    raw = F.trim(F.col(url) if isinstance(url, str) else url)
    valid = U.is_valid(raw)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    opaque = ~valid & (scheme != "") & ~raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    host = F.when(opaque, F.lit("")).otherwise(U.get_domain(raw))
    no = F.lit(None).cast("string")
    rules: list[tuple[Column, Column | str]] = [
        (~valid & ~opaque, F.lit("Malformed URL: Invalid URL") if policy.filter_malformed else no),
    ]
    if start_url is not None:
        a, b = U.comparison_domain(host, policy.www), U.comparison_domain(U.get_domain(start_url), policy.www)
        same = (a == b) | a.endswith(F.concat(F.lit("."), b)) if policy.subdomains == "ignore" else a == b
        allowed = scheme.isin(list(policy.allowed_protocols))
        if policy.protocol == "strict":
            allowed = allowed & (scheme == U.scheme(start_url))
        reason = F.concat(F.lit("Domain/protocol "), host, F.lit(" ("), scheme, F.lit(":) restricted to starting domain "), U.get_domain(start_url), F.lit(" ("), U.scheme(start_url), F.lit(":)"))
        rules.append((U.is_valid(start_url) & ~(same & allowed), reason))
    if policy.filter_long:
        rules.append((F.length(raw) > policy.max_length, F.concat(F.lit("URL length "), F.length(raw).cast("string"), F.lit(f" exceeds maximum {policy.max_length}"))))
    if policy.filter_schemes:
        names = ", ".join(f"{p}:" for p in policy.allowed_protocols)
        rules.append((~scheme.isin(list(policy.allowed_protocols)), F.concat(F.lit("Protocol "), scheme, F.lit(f": not in allowed schemes: {names}"))))
    if policy.allowed_domains:
        rules.append((~_in_domain(host, policy.allowed_domains), F.concat(F.lit("Domain "), host, F.lit(" not in allowlist"))))
    if policy.blocked_domains:
        rules.append((_in_domain(host, policy.blocked_domains), F.concat(F.lit("Domain "), host, F.lit(" is blocked"))))
    for p in policy.custom_filters:
        rules.append((raw.rlike(p), F.lit(f"URL matches custom filter pattern: /{p}/")))
    if from_url is not None:
        here = (U.get_domain(from_url) == U.get_domain(raw)) & (U.path(from_url) == U.path(raw)) & (U.search(from_url) == U.search(raw)) & (U.fragment(raw) != "")
        rules.append((F.coalesce(here, F.lit(False)), F.lit("Fragment-only link to same page")))
    ext = extension_reason(raw, policy)
    rules.append((ext.isNotNull(), ext))
    out = F
    for condition, reason in rules:
        out = out.when(condition, reason)
    return out.otherwise(no)
