"""One object for a crawl over stored pages: starts, policy, robots, limits; then run."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from .functions.url import Strategy
from .operators import crawl as W
from .operators import dedup, links, pages, tokens
from .operators.extract import extract_fields
from .operators.follow import FollowPolicy
from .plans.config import CrawlConfig


@dataclass(frozen=True)
class Crawl:
    """``Crawl(pages).with_starts(df).configured(CrawlConfig(max_depth=3)).run()``; pages: page_id, url, html and, optionally, error_kind."""

    pages: DataFrame
    starts: DataFrame | None = None
    robots: DataFrame | None = None
    config: CrawlConfig = CrawlConfig()
    redirects: DataFrame | None = None
    exact_urls: bool = False

    def with_starts(self, starts: DataFrame) -> "Crawl":
        """start_id, url."""
        return replace(self, starts=starts)

    def with_robots(self, robots: DataFrame) -> "Crawl":
        """origin, status, body, cause."""
        return replace(self, robots=robots)

    def with_redirects(self, redirects: DataFrame) -> "Crawl":
        """url, final_url of start pages."""
        return replace(self, redirects=redirects)

    def policy(self, policy: FollowPolicy) -> "Crawl":
        return replace(self, config=replace(self.config, follow=policy))

    def configured(self, config: CrawlConfig) -> "Crawl":
        return replace(self, config=config)

    def unique_starts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(kept, skipped, stats): one start per host, as a crawl takes them."""
        return dedup.dedup_urls(self.starts, Strategy(protocol="preserve"), order="start_id")

    def links(self) -> DataFrame:
        """url (of the page), pos, abs_url in the order in which a crawl follows them."""
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        found = links.resolve_links(links.extract_links(self.pages), self.exact_urls)
        order = Window.partitionBy("page_id").orderBy("ix", "pos")
        return found.withColumn("pos", F.row_number().over(order)).select("url", "pos", "abs_url")

    def _starts(self) -> DataFrame:
        kept = self.unique_starts()[0].select("start_id", "url")
        if self.redirects is None:
            return kept
        moved = dedup.effective_starts(kept, self.redirects, self.config.follow_cross_domain_redirects)
        return moved.drop("url").withColumnRenamed("effective_url", "url")

    def run(self) -> W.CrawlTables:
        c = self.config
        columns = ["url", "error_kind"] if "error_kind" in self.pages.columns else ["url"]
        return W.crawl(self._starts(), self.pages.select(*columns), self.links(), c.follow, None if c.ignore_robots else self.robots, c.max_depth, c.max_pages)

    def run_passes(self) -> DataFrame:
        """Summaries of all passes of the configured domain retry."""
        c = self.config
        columns = ["url", "error_kind"] if "error_kind" in self.pages.columns else ["url"]
        return W.crawl_passes(self._starts(), [self.pages.select(*columns)], self.links(), c.domain_retry or W.DomainRetry(), policy=c.follow, robots=None if c.ignore_robots else self.robots, max_depth=c.max_depth, max_pages=c.max_pages)

    def page_data(self) -> DataFrame:
        return pages.parse_pages(self.pages)

    def tokens(self) -> DataFrame:
        return tokens.extract_tokens(self.pages)

    def extract(self, config: dict) -> DataFrame:
        return extract_fields(self.pages, config)
