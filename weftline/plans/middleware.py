"""Chains of table transforms in the place of per-request hooks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.classify import sticky_choice
from ..functions.text import map_merge

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Middleware:
    name: str
    request: Transform | None = None
    response: Transform | None = None
    exception: Transform | None = None


def process_requests(requests: DataFrame, chain: Sequence[Middleware]) -> DataFrame:
    """In order."""
    for m in chain:
        if m.request:
            requests = requests.transform(m.request)
    return requests


def process_responses(responses: DataFrame, chain: Sequence[Middleware]) -> DataFrame:
    """In reverse order."""
    for m in reversed(chain):
        if m.response:
            responses = responses.transform(m.response)
    return responses


def process_exceptions(errors: DataFrame, chain: Sequence[Middleware]) -> DataFrame:
    """``errors`` with recovery, in reverse order: every hook sees all errors, and a later hook's answer replaces an earlier one."""
    out = errors if "recovery" in errors.columns else errors.withColumn("recovery", F.lit(None).cast("string"))
    for m in reversed(chain):
        if m.exception:
            new = out.drop("recovery").transform(m.exception)
            keys = [c for c in errors.columns if c != "recovery"]
            out = new.withColumnRenamed("recovery", "__new").join(out.withColumnRenamed("recovery", "__old"), keys).select(*keys, F.coalesce("__new", "__old").alias("recovery"))
    return out


def user_agents(agents: Sequence[str]) -> Middleware:
    """Sets the user agent, one per domain, over what the caller gave."""

    def set_agent(r: DataFrame) -> DataFrame:
        agent = F.create_map(F.lit("user-agent"), sticky_choice(U.get_domain("url"), list(agents)))
        return r.withColumn("headers", map_merge(F.coalesce("headers", F.create_map().cast("map<string,string>")), agent))

    return Middleware("user_agents", request=set_agent)


def logging(observation: Observation) -> Middleware:
    """Counts responses on the side of whatever job runs them."""
    return Middleware("logging", response=lambda r: r.observe(observation, F.count("*").alias("responses"), F.count_if(F.col("status") >= 400).alias("errors")))


def rate_limited(per_second: float) -> Middleware:
    """Adds wait_s to requests (domain, ts, request_id)."""
    from ..streaming.stateful import token_bucket_waits

    return Middleware("rate_limited", request=lambda r: token_bucket_waits(r, per_second))
