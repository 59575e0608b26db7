"""Crawl settings and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.classify import ERROR_KINDS, RetryPolicy
from ..operators.crawl import DomainRetry
from ..operators.follow import FollowPolicy

COMPLETION_REASONS = ("queue_empty", "max_pages", "robots_blocked", "all_fetches_failed", "interrupted", "error")


@dataclass(frozen=True)
class CrawlConfig:
    follow: FollowPolicy = field(default_factory=FollowPolicy)
    fetch_retry: RetryPolicy | None = None
    domain_retry: DomainRetry | None = None
    max_depth: int | None = None
    max_pages: int | None = None
    ignore_robots: bool = False
    robots_delay_cap_ms: int = 2000
    follow_cross_domain_redirects: bool = False
    result_capacity: int | None = None  # None: unbounded
    heartbeat: str = "warn"  # off, warn, interrupt
    heartbeat_threshold_s: int = 300
    grace_ms: int = 5000
    stop: str = "drain"  # drain, interrupt
    user_agents: tuple[str, ...] = ("weftline",)

    def __post_init__(self) -> None:
        errors = []
        if self.max_depth is not None and self.max_depth < 0:
            errors.append("max_depth must be 0 (unlimited) or more")
        if self.max_pages is not None and self.max_pages < 1:
            errors.append("max_pages must be at least 1")
        if self.result_capacity is not None and not 1 <= self.result_capacity <= 1_000_000:
            errors.append("result_capacity must be between 1 and 1000000")
        if self.robots_delay_cap_ms < 0 or self.grace_ms < 0:
            errors.append("delays must be 0 or more")
        if self.heartbeat not in ("off", "warn", "interrupt"):
            errors.append("heartbeat must be off, warn or interrupt")
        if self.heartbeat_threshold_s <= 0:
            errors.append("heartbeat_threshold_s must be positive")
        if self.stop not in ("drain", "interrupt"):
            errors.append("stop must be drain or interrupt")
        if not self.user_agents or not all(self.user_agents):
            errors.append("user_agents must name at least one agent")
        if self.domain_retry and (unknown := set(self.domain_retry.reasons) - set(COMPLETION_REASONS)):
            errors.append(f"unknown completion reasons: {sorted(unknown)}")
        if errors:
            raise ValueError("; ".join(errors))

    def source_options(self) -> dict[str, str]:
        """How a stream's intake is capped, in place of a bounded channel."""
        return {} if self.result_capacity is None else {"maxFilesPerTrigger": str(max(1, self.result_capacity // 1000))}


# ---- error taxonomy

ERROR_CLASSES = {
    "crawler": ("CrawlError", "FetchFailed", "QueueError", "ConfigurationError", "ValidationError", "ParseError", "ContentTypeError", "RobotsError", "SinkError", "PersistenceError", "SessionError", "TokenError"),
    "network": ("NetworkError", "ResponseError", "RequestAbortError", "RateLimited", "DnsError", "TlsError"),
    "browser": ("BrowserError", "NavigationError", "ElementNotFound", "BrowserTimeout"),
}


def error_family(error_class):
    """Column: crawler, network, browser or null."""
    from pyspark.sql import functions as F

    c = F.col(error_class) if isinstance(error_class, str) else error_class
    out = F
    for family, names in ERROR_CLASSES.items():
        out = out.when(c.isin(list(names)), family)
    return out.otherwise(F.lit(None).cast("string"))


__all__ = ["COMPLETION_REASONS", "ERROR_CLASSES", "ERROR_KINDS", "CrawlConfig", "error_family"]
