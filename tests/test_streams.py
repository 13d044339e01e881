"""Streaming jobs over several micro-batches with late events, and over two runs on one checkpoint."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lexloom.operators.crawl_state import RECORD_COLUMNS
from lexloom.operators.record_log import RecordLog
from lexloom.plans.ingestion import process_crawl
from lexloom.streaming import jobs as J

SCHEMA = "event_id long, user long, created_at timestamp"


def write(spark, folder, name, rows):
    df = spark.createDataFrame([(i, u, s) for i, u, s in rows], "event_id long, user long, s long")
    df.select("event_id", "user", F.timestamp_seconds("s").alias("created_at")).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def test_rate_limit_counts_late_seconds(spark, tmp_path):
    rng = random.Random(1)
    start = 1_700_000_000
    events = [(i, rng.randint(1, 3), start + i * 20 + rng.randint(0, 5)) for i in range(200)]
    late = sorted(events, key=lambda e: e[2] + rng.choice([0, 0, 300]))  # up to five minutes late
    for k in range(4):
        write(spark, str(tmp_path / "in"), f"f{k}", late[k * 50 : (k + 1) * 50])
    out = J.run_to_table(J.rate_limit(stream(spark, str(tmp_path / "in")), ["user"], "created_at", 3, 120), "limit", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.user, r.second): r.n for r in out.groupBy("user", "second").agg(F.max("n_seconds").alias("n")).collect()}
    seconds = {}
    for _, u, s in events:
        seconds.setdefault(u, set()).add(s)
    counts = {(u, s): sum(s - 120 < x <= s for x in own) for u, own in seconds.items() for s in own}
    assert got == {k: n for k, n in counts.items() if n > 3} and got


def test_rate_limit_calls_follow_buckets_not_keys(spark, tmp_path):
    """Several keys to a call, null and odd ones too, late seconds, over two runs on one checkpoint; a quiet key leaves and comes back."""
    rng = random.Random(2)
    start = 1_700_000_000
    names = ["a", "", None, 'q"{', "é\u2028", *[f"k{i}" for i in range(40)]]
    events = [(rng.choice(names), rng.choice([None, 1, 2**60 + 1]), start + rng.randint(0, 1_500)) for _ in range(1_200)] + [("quiet", 1, start + s) for s in (1, 2, 3, 1_400, 1_401, 1_402)]
    events.sort(key=lambda e: e[2] + rng.choice([0, 0, 100]))
    kind, folder = "name string, user long, s long", str(tmp_path / "in")

    def job(buckets=4):
        source = spark.readStream.schema("name string, user long, created_at timestamp").option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
        return J.rate_limit(source, ["name", "user"], "created_at", 2, 90, 120, buckets=buckets)

    def feed(lo, hi):
        for k in range(lo, hi):
            spark.createDataFrame(events[k * 201 : k * 201 + 201], kind).select("name", "user", F.timestamp_seconds("s").alias("created_at")).coalesce(1).write.parquet(f"{folder}/f{k}")

    feed(0, 4)
    J.run_to_table(job(), "limit", str(tmp_path / "out"), str(tmp_path / "state"))
    feed(4, 6)
    out = J.run_to_table(job(), "limit", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["name"], r.user, r.second): r.n for r in out.groupBy("name", "user", "second").agg(F.max("n_seconds").alias("n")).collect()}
    seconds = {}
    for n, u, s in events:
        seconds.setdefault((n, u), set()).add(s)
    want = {(*k, s): sum(s - 90 < x <= s for x in own) for k, own in seconds.items() for s in own}
    assert got == {k: n for k, n in want.items() if n > 2} and got


def test_volume_flushes_open_windows_and_resumes(spark, tmp_path):
    day, start = 86_400, 1_700_006_400 // 86_400 * 86_400
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = [(i, 1, start + i * 3_600) for i in range(60)]
    write(spark, folder, "a", first)
    run = lambda: {r.start.timestamp(): r.n_queries for r in J.latest(J.run_to_updates(J.volume(stream(spark, folder)), "v", out, state), ["start"]).collect()}
    want = Counter((s // day) * day for _, _, s in first)
    assert run() == dict(want)
    more = [(100 + i, 1, start + (59 + i) * 3_600) for i in range(20)]
    write(spark, folder, "b", more)
    want.update((s // day) * day for _, _, s in more)
    assert run() == dict(want)
    assert len(list((tmp_path / "out").glob("_batch=*"))) >= 2


def _record(spark, urls):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return spark.createDataFrame([(u,) for u in urls], "url string").select(
        "url", F.lit("news").alias("source_type"), F.lit("LAW").alias("doc_type"), F.lit("t").alias("title"), F.md5(F.lit("old")).alias("content_hash"),
        F.lit("unchanged").alias("status"), F.lit(None).cast("string").alias("error_message"), at.alias("last_scraped_at"), at.alias("last_changed_at"), F.lit(1).alias("scrape_count")
    ).select(*RECORD_COLUMNS)


def test_crawl_over_batches_and_runs_equals_one_batch(spark, tmp_path):
    """Twelve micro-batches in two runs on one folder, with compaction, against the batch operators over all pages."""
    rng = random.Random(3)
    first = _record(spark, [f"u{i}" for i in range(400)])
    pages = [(i, f"u{rng.randint(0, 430)}", rng.choice(["old", "old", "a", "b", None])) for i in range(120)]
    kind = "page_id long, url string, content string"
    folder = str(tmp_path / "in")
    # a page without content uses the older form's column in the job; here it fails
    shape = lambda df: df.select("page_id", "url", F.lit("news").alias("source_type"), F.lit("LAW").alias("doc_type"), F.lit("t").alias("title"), "content", F.lit(None).cast("string").alias("clean_text"))

    def feed(lo, hi):
        for k in range(lo, hi):
            spark.createDataFrame(pages[k * 10 : k * 10 + 10], kind).coalesce(1).write.parquet(f"{folder}/f{k:02d}")

    def job():
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
        return J.crawl_changes(shape(source), first, F.lit("2024-02-01 00:00:00").cast("timestamp"), path=str(tmp_path / "crawl"), compact_after=4)

    feed(0, 7)
    results, _ = job()
    assert results.count() == 70
    feed(7, 12)
    results, records = job()
    whole = process_crawl(shape(spark.createDataFrame(pages, kind)), first, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    columns = ["page_id", "url", "result", "title"]
    assert sorted(map(tuple, results.select(*columns).collect())) == sorted(map(tuple, whole["results"].select(*columns).collect()))
    state = ["url", "content_hash", "scrape_count", "last_changed_at"]
    assert sorted(map(tuple, records.select(*state).collect())) == sorted(map(tuple, whole["records"].select(*state).collect()))
    log = RecordLog(spark, str(tmp_path / "crawl" / "records"), first.schema)
    assert log.batches() == list(range(-1, 12))
    written = {n: log._read(s).count() for (k, n), s in log._live().items() if k == "delta"}
    assert written.pop(-1) == 400
    assert written == {n: len({u for _, u, c in pages[n * 10 : n * 10 + 10] if c}) for n in range(12)}  # the changes, not the records


def test_log_merges_replaces_and_compacts_only_full_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], "url string, v int").schema
    log = RecordLog(spark, str(tmp_path / "log"), schema, buckets=8)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    state = lambda **kw: {r.url: r.v for r in log.state(**kw).collect()}
    assert state() == {} and log.compact(1) == []
    log.append(rows(*[(f"k{i}", 0) for i in range(40)]), -1)
    for n in range(4):
        log.append(rows(("k1", n + 1), (f"n{n}", n)), n)
    log.append(rows(("k1", 40)), 3)  # run again: replaces its delta
    want = {f"k{i}": 0 for i in range(40)} | {"k1": 40, "n0": 0, "n1": 1, "n2": 2}
    assert state() == want and state(before=2)["k1"] == 2 and "n2" not in state(before=2)
    hit = log.compact(5)
    own = {r.url: r.b for r in rows(("k1", 0)).select("url", F.pmod(F.xxhash64("url"), F.lit(8)).alias("b")).collect()}
    assert own["k1"] in hit and len(hit) < 8 and log.compact(5) == []
    base = [s for (k, _), s in log._live().items() if k == "base"]
    assert {r._bucket for r in log._read(base[0]).select("_bucket").distinct().collect()} == set(hit)
    assert state() == want and state(before=2)["k1"] == 2
    log.append(rows(("k1", 50)), 4)
    assert state() == want | {"k1": 50} and log.append(rows(), 5) is None and state() == want | {"k1": 50}
