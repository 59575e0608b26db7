"""Cases that the oracles don't hold: golden robots verdicts, replay properties, sources, sinks and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import dedup, robots, state
from weftline.operators.crawl import DomainRetry
from weftline.operators.follow import EXTENSIONS, FollowPolicy
from weftline.plans.config import CrawlConfig
from weftline.sources import files, pages
from weftline.sources.state_store import FileStateStore
from weftline.streaming import stateful


def test_longest_match_does_not_depend_on_rule_order(spark):
    rules = ["Disallow: /a", "Allow: /a/b", "Disallow: /a/b/c", "Allow: /*.html$"]
    urls = spark.createDataFrame([(f"https://x.example{p}",) for p in ("/a", "/a/b", "/a/b/c/d", "/a/z.html", "/q")], "url string")
    seen = set()
    for k in range(4):
        random.Random(k).shuffle(rules)
        body = "User-agent: *\n" + "\n".join(rules)
        table = spark.createDataFrame([("https://x.example", 200, body, None)], "origin string, status int, body string, cause string")
        seen.add(tuple(sorted((r["url"], r["allowed"]) for r in robots.robots_verdict(urls, table).collect())))
    assert len(seen) == 1
    assert dict(next(iter(seen))) == {"https://x.example/a": False, "https://x.example/a/b": True, "https://x.example/a/b/c/d": False, "https://x.example/a/z.html": True, "https://x.example/q": True}


def test_oversized_robots_is_unavailable(spark):
    row = spark.createDataFrame([(200, "x" * (robots.MAX_BYTES + 1), None)], "status int, body string, cause string").select(robots.fetch_outcome().alias("o")).first()["o"]
    assert (row["state"], row["cause"]) == ("unavailable", "body too large")


def _replay(log):
    pending, visited, n = [], [], 0
    for _, op, f in sorted(log):
        if op == "enqueue":
            pending.append(f)
        elif op == "dequeue" and f in pending:
            pending.remove(f)
            n += 1
        elif op == "mark_visited" and f not in visited:
            visited.append(f)
    return pending, sorted(visited), n


@pytest.mark.parametrize("seed", range(4))
def test_replay_is_the_fold(spark, seed):
    r = random.Random(seed)
    log = [(i, r.choice(["enqueue", "enqueue", "dequeue", "mark_visited"]), r.choice("abc")) for i in range(60)]
    rows = spark.createDataFrame([("s", *x) for x in log], "session_id string, sequence long, op string, fingerprint string")
    full = state.as_state(*state.replay(rows)).first()
    assert (full["pending"], full["visited"], full["total_processed"]) == _replay(log)
    middle = state.as_state(*state.replay(rows.where("sequence <= 30"))).withColumn("sequence", F.lit(30).cast("long")).select("session_id", "sequence", "pending", "visited", "total_processed")
    rest = state.as_state(*state.replay(rows.where("sequence > 20"), middle)).first()
    assert (rest["pending"], rest["visited"], rest["total_processed"]) == _replay(log)


def test_dedup_never_grows(spark):
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(["https://a.example/", "https://www.a.example/x", "bad", None, "http://b.example"])], "pos int, url string")
    kept, skipped, stats = dedup.dedup_urls(urls)
    s = stats.first()
    assert kept.count() == s["unique"] == 2 and (s["total"], s["duplicates"], s["invalid"]) == (5, 1, 2)
    assert {r["reason"] for r in skipped.collect()} == {"Duplicate of: https://a.example/", "Invalid URL: bad", "Invalid URL: null"}


def test_extension_table_size():
    assert {c: len(x) for c, (_, x) in EXTENSIONS.items()} == {"archives": 8, "images": 20, "audio": 9, "video": 15, "office": 21, "other": 18}


def test_config_checks():
    CrawlConfig(domain_retry=DomainRetry())
    for bad in ({"result_capacity": 0}, {"max_pages": 0}, {"heartbeat": "no"}, {"user_agents": ()}, {"domain_retry": DomainRetry(reasons=("odd",))}):
        with pytest.raises(ValueError):
            CrawlConfig(**bad)
    with pytest.raises(ValueError):
        FollowPolicy(custom_filters=("(",))
    assert state.SnapshotPolicy().due(1000, 900) and state.SnapshotPolicy().due(700, 100) and not state.SnapshotPolicy().due(700, 300)
    assert [state.choose_strategy(set(x)) for x in (("delta", "snapshot"), ("delta",), ())] == ["hybrid", "delta", "full"]


def test_stored_pages_source(spark, tmp_path):
    rows = [{"url": f"https://a.example/{i}", "status": 200 + 4 * (i % 2) * 51, "headers": {"Set-Cookie": ["a=1", "b=2"]}, "body": "é" * i} for i in range(50)]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    pages.register(spark)
    for split in (64, 1 << 20):
        got = spark.read.format("stored_pages").option("split_bytes", split).load(str(tmp_path)).collect()
        assert sorted(r["url"] for r in got) == sorted(r["url"] for r in rows)
        assert got[0]["headers"] == {"set-cookie": "a=1\nb=2"}


def test_source_resolution(spark):
    default, other = (lambda s: "d"), (lambda s: "o")
    assert pages.resolve_source(None, {}, default) is default
    assert pages.resolve_source(other, {}, default) is other
    assert pages.resolve_source(pages.selector(lambda r: other), {}, default) is other
    assert pages.resolve_source(pages.selector(lambda r: 1 / 0), {}, default) is pages.no_pages
    assert pages.resolve_source("odd", {}, default) is pages.no_pages


def test_state_store(spark, tmp_path):
    store = FileStateStore(spark, f"file://{tmp_path}/state")
    assert store.deltas().count() == 0
    d = spark.sql("SELECT 's' AS session_id, id AS sequence, timestamp_seconds(id) AS ts, 'enqueue' AS op, concat('f', id) AS fingerprint, CAST(NULL AS STRING) AS request FROM range(10)")
    store.save_deltas(d)
    store.save_deltas(d.where("sequence = 3"))
    assert store.deltas().count() == 10 and store.deltas(since=6).count() == 3
    store.save_snapshot(spark.sql("SELECT 's' AS session_id, 7L AS sequence, timestamp_seconds(7) AS ts, array('x') AS pending, array('y') AS visited, 4L AS total_processed"))
    store.compact()
    assert sorted(r["sequence"] for r in store.deltas().collect()) == [7, 8, 9]
    store.delete("s")
    assert store.deltas().count() == 0


def test_files(spark, tmp_path):
    p = str(tmp_path / "d" / "a.json")
    files.save_json(p, {"a": 1})
    assert files.load_json(p) == {"a": 1} and files.load_json(str(tmp_path / "no"), default={}) == {}
    assert files.walk(str(tmp_path)) == [p] and files.stat(p)["is_file"]
    assert files.read_texts(spark, str(tmp_path)).count() == 1 and files.listing(spark, str(tmp_path)).first()["length"] > 0
    files.move(p, p + "2")
    files.delete(p + "2")
    assert not files.exists(p)


def test_streaming_seen_set_and_sink(spark, tmp_path):
    src = str(tmp_path / "in")
    out: list[int] = []
    for batch in (["https://a.example/", "https://a.example/#x", "https://b.example"], ["https://a.example", "https://c.example/"]):
        spark.createDataFrame([(u,) for u in batch], "url string").coalesce(1).write.mode("append").parquet(src)
        stream = stateful.first_seen_stream(spark.readStream.schema("url string").parquet(src))
        stateful.run_sink(stream, lambda df, n: out.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(out) == 3


def test_silent_workers(spark, tmp_path):
    src = str(tmp_path / "in")
    for rows in ([("w1", 5), ("w2", 5)], [("w1", 400)], [("w3", 2000)], [("w3", 2001)]):
        spark.createDataFrame(rows, "worker_id string, s long").selectExpr("worker_id", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(src)
        q = stateful.stale_stream(spark.readStream.schema("worker_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["worker_id"]: r["last_ms"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"w1": 400_000, "w2": 5_000}
