"""Sessions, tokens and storage as latest-row-per-key tables; cookies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import map_merge

TOKEN_TTL_S = 3600
SESSION_TTL_S = 24 * 3600
TOKEN_TYPES = ("CSRF", "API", "AUTH", "REFRESH")
SESSION_SCHEMA = "id string, cookies string, tokens array<struct<type:string,value:string,expiry:timestamp,scope:array<string>>>, user_data map<string,string>, created_at timestamp, last_used_at timestamp, expires_at timestamp"


def with_expiry(rows: DataFrame, created: str, ttl_s: int, name: str = "expires_at") -> DataFrame:
    return rows.withColumn(name, F.timestamp_seconds(F.unix_seconds(created) + ttl_s))


def is_live(expiry: Column | str, as_of: Column) -> Column:
    """No expiry, or one that isn't past."""
    e = F.col(expiry) if isinstance(expiry, str) else expiry
    return e.isNull() | (e >= as_of)


def upsert(current: DataFrame, changes: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key, by sequence."""
    both = current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("__row")).select(*key, "__row.*")


def load_session(sessions: DataFrame, wanted: DataFrame, as_of: Column) -> DataFrame:
    """``wanted`` (id) with status: ok, not_found or expired."""
    j = wanted.join(sessions.select("id", "expires_at", F.lit(True).alias("__found")), "id", "left")
    return j.select("id", F.when(F.col("__found").isNull(), "not_found").when(~is_live("expires_at", as_of), "expired").otherwise("ok").alias("status"))


def update_user_data(sessions: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Shallow merge: of equal keys the update's value wins; last_used_at becomes ``as_of``."""
    j = sessions.join(updates.select("id", F.col("user_data").alias("__new")), "id", "left")
    empty = F.create_map().cast("map<string,string>")
    merged = F.when(F.col("__new").isNotNull(), map_merge(F.coalesce("user_data", empty), F.col("__new"))).otherwise(F.col("user_data"))
    return j.withColumn("user_data", merged).withColumn("last_used_at", F.when(F.col("__new").isNotNull(), as_of).otherwise(F.col("last_used_at"))).drop("__new")


def export_session(sessions: DataFrame) -> DataFrame:
    """``id, json``"""
    return sessions.select("id", F.to_json(F.struct(*[c for c in sessions.columns])).alias("json"))


def import_session(exported: DataFrame) -> DataFrame:
    """Sessions from their JSON; rows that don't fit are left out, and tokens of unknown types are dropped."""
    s = exported.select(F.from_json("json", SESSION_SCHEMA).alias("__session")).where("__session.id IS NOT NULL").select("__session.*")
    return s.withColumn("tokens", F.filter("tokens", lambda t: t["type"].isin(list(TOKEN_TYPES))))


def valid_tokens(tokens: DataFrame, as_of: Column) -> DataFrame:
    """The last token of each type that isn't past its expiry; ``tokens``: seq, type, value, expiry."""
    last = tokens.groupBy("type").agg(F.max_by(F.struct("value", "expiry"), "seq").alias("__token")).select("type", "__token.*")
    return last.where(is_live("expiry", as_of))


_COOKIE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "value", "domain", "path")] + [T.StructField("secure", T.BooleanType()), T.StructField("host_only", T.BooleanType())]))


def parse_jar(json: Column | str) -> Column:
    return F.from_json(F.col(json) if isinstance(json, str) else json, _COOKIE)


def cookie_matches(host: Column, path: Column, secure: Column, cookie: Column) -> Column:
    """RFC 6265: domain match unless host-only, path match, and secure cookies on secure requests only."""
    d = F.regexp_replace(F.lower(cookie["domain"]), r"^\.", "")
    domain = F.when(F.coalesce(cookie["host_only"], F.lit(False)), host == d).otherwise((host == d) | host.endswith(F.concat(F.lit("."), d)))
    p = F.coalesce(cookie["path"], F.lit("/"))
    below = (path == p) | (path.startswith(p) & (p.endswith("/") | (F.substring(path, F.length(p) + 1, F.lit(1)) == "/")))
    return domain & below & (~F.coalesce(cookie["secure"], F.lit(False)) | secure)


def cookie_header(host: Column, path: Column, secure: Column, jar: Column) -> Column:
    """The Cookie header of a request: longer paths first, else the jar's order."""
    sent = F.filter(jar, lambda c: F.coalesce(cookie_matches(host, path, secure, c), F.lit(False)))
    keyed = F.transform(sent, lambda c, i: F.struct((-F.length(F.coalesce(c["path"], F.lit("/")))).alias("n"), i.alias("i"), F.concat(c["name"], F.lit("="), c["value"]).alias("s")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["s"]), "; ")


def storage_state(changes: DataFrame) -> DataFrame:
    """``store, key, value`` of local and session storage after put, remove and clear rows (store, seq, op, key, value)."""
    cleared = changes.where("op = 'clear'").groupBy("store").agg(F.max("seq").alias("__c"))
    live = changes.where("op <> 'clear'").join(cleared, "store", "left").where("__c IS NULL OR seq > __c")
    last = live.groupBy("store", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("__last"))
    return last.where("__last.op = 'put'").select("store", "key", "__last.value")


