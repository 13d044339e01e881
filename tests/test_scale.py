"""Skew-safe helpers against brute force, with limits forced low."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.catalog import retrieval
from lexloom.operators import crawl_state, postings, ranking, sections, sessions, skew, vectors
from lexloom.operators.cells import CellIndex
from lexloom.operators.chunking import case_pieces, law_pieces, pack_paragraphs
from lexloom.operators.postings import WordIndex
from lexloom.plans import court_search
from lexloom.session import materialise


def test_split_rank_equals_row_number(spark):
    # one key holds most rows
    df = spark.range(5000).select(F.col("id").alias("v"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    got = skew.split_rank(df, ["k"], ["v"], F.floor(F.col("v") / 97), "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    assert got.select("k", "v", "r").exceptAll(want.select("k", "v", "r")).count() == 0 and got.count() == 5000


def test_text_ids_that_begin_alike_are_spread(spark):
    """A thousand ids with one common beginning lie in many buckets, in their order, and ranks stay exact."""
    df = spark.range(1000).select(F.format_string("doc-%06d", "id").alias("v"), F.when(F.col("id") % 3 < 2, "hot").alias("k"))
    df = df.unionByName(spark.createDataFrame([(None, "hot"), ("a", "hot"), ("é", None)], "v string, k string"))
    bucket = skew.arrival_bucket(df, "v", 100)
    per = df.select("v", bucket.alias("b")).collect()
    assert len({r.b for r in per}) > 200 and {r.b for r in per if r.v is None} == {0}
    placed = [r.b for r in sorted((r for r in per if r.v is not None), key=lambda r: r.v.encode())]
    assert placed == sorted(placed)
    got = skew.split_rank(df, ["k"], ["v"], bucket, "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    assert got.select("k", "v", "r").exceptAll(want.select("k", "v", "r")).count() == 0 and got.count() == 1003
    assert skew.split_rank(df.limit(0), ["k"], ["v"], skew.arrival_bucket(df.limit(0), "v", 100), "r").count() == 0


def test_lookback_blocks_keep_windows_exact(spark):
    df = spark.range(1000).select(F.lit("s").alias("session_id"), F.col("id").alias("turn"), F.concat(F.lit("q"), "id").alias("query"),
                                  F.lit("a").alias("answer"), F.when(F.col("id") % 7 == 0, F.col("id").cast("string")).alias("topic"))
    small = sessions.session_context(df, width=13, block=17)
    large = sessions.session_context(df, width=10_000, block=10_000)
    cols = ["turn", "last_query", "last_topic", "turn_count", "history_text"]
    assert small.select(*cols).exceptAll(large.select(*cols)).count() == 0 and small.count() == 1000
    assert small.where("turn = 500").first().turn_count == 10


def test_rate_limit_spans(spark):
    random.seed(1)
    secs = sorted(random.sample(range(100_000), 4000))
    df = spark.createDataFrame([("hot", s) for s in secs], "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    got = {(r.second, r.n_seconds) for r in sessions.rate_limit_violations(df, ["k"], "at", 4, 60, span=60).collect()}
    want = set()
    for i, s in enumerate(secs):
        n = sum(1 for x in secs[max(0, i - 60):i + 1] if x > s - 60)
        if n > 4:
            want.add((s, n))
    assert got == want and want


def test_repeated_urls_in_one_batch(spark):
    rows = [(i, "u", "a" if i % 4 < 2 else "b") for i in range(200)] + [(900, "v", "x")]
    now = spark.createDataFrame(rows, "page_id long, url string, content string")
    prev = spark.createDataFrame([("u", "zz", "unchanged"), ("w", "q", "failed")], "url string, content_hash string, status string")
    got = {r.page_id: r.change_type for r in crawl_state.detect_changes(now, prev, width=7, block=3).collect()}
    want, last = {}, "zz"
    import hashlib

    for i, _, c in rows[:200]:
        h = hashlib.md5(c.encode()).hexdigest()
        want[i] = "unchanged" if h == last else "changed"
        last = h
    want[900] = "new"
    assert got == want


def test_same_hash_after_failure_is_changed_and_self_snapshot_is_unchanged(spark):
    import hashlib

    h = hashlib.md5(b"x").hexdigest()
    now = spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], "page_id long, url string, content string")
    prev = spark.createDataFrame([("u", h, "failed"), ("v", h, "unchanged")], "url string, content_hash string, status string")
    assert [r.change_type for r in crawl_state.detect_changes(now, prev).orderBy("page_id").collect()] == ["changed", "unchanged"]


def _vectors(spark, n, seed, key):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(n)], f"{key} long, embedding array<float>")


def _brute(q, x, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    qm = unit(np.array([r.embedding for r in q], dtype=float))
    xm = unit(np.array([r.embedding for r in x], dtype=float))
    s = np.round(qm @ xm.T, 9)
    out = set()
    for i, r in enumerate(q):
        best = sorted(range(len(x)), key=lambda j: (-s[i, j], x[j].chunk_id))[:k]
        out |= {(r.query_id, x[j].chunk_id, n + 1) for n, j in enumerate(best)}
    return out


def test_knn_exact_in_both_forms(spark):
    q, x = _vectors(spark, 15, 1, "query_id"), _vectors(spark, 400, 2, "chunk_id").repartition(5)
    want = _brute(q.collect(), sorted(x.collect(), key=lambda r: r.chunk_id), 7)
    for limit in (vectors.BROADCAST_BYTES, 8 * 8 * 4):  # the second forces the grid
        got = {(r.query_id, r.chunk_id, r.dense_pos) for r in vectors.knn(q, x, 7, max_broadcast=limit).collect()}
        assert got == want


def test_knn_cells_restrict_the_search(spark):
    q = _vectors(spark, 4, 1, "query_id").withColumn("cells", F.array(F.lit("a")))
    x = _vectors(spark, 60, 2, "chunk_id").withColumn("cells", F.when(F.col("chunk_id") < 20, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))))
    got = vectors.knn(q, x, 30).collect()
    assert len(got) == 80 and all(r.chunk_id < 20 for r in got)


def test_cell_index_recall_reuse_and_pruning(spark, tmp_path):
    """Built once and reused; questions are not in the table; only folders of probed cells are read."""
    q, x = _vectors(spark, 40, 3, "query_id"), _vectors(spark, 3_000, 4, "chunk_id")
    exact = {(r.query_id, r.chunk_id) for r in vectors.knn(q, x, 16).collect()}
    index = CellIndex(spark, str(tmp_path / "cells"))
    with pytest.raises(ValueError):
        index.search(q, 16)
    assert index.build(x.where("chunk_id < 2000")) == 2_000 and len(index.sizes()) == 45
    assert index.append(x.where("chunk_id >= 1500")) == 1_000 and index.append(x.limit(20)) == 0
    again = CellIndex(spark, str(tmp_path / "cells"))
    assert sum(again.sizes().values()) == 3_000 and again.build(x) == 0 and again.probes() < 45
    near = {(r.query_id, r.chunk_id) for r in again.search(q, 16).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert {(r.query_id, r.chunk_id) for r in again.search(q, 16, probes=45).collect()} == exact
    _, few = again.candidates(q.limit(1), probes=2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and few.select("cell").distinct().count() == 2
    assert index.search(q.limit(0), 16).count() == 0


def test_overfull_cells_are_split(spark, tmp_path):
    x = _vectors(spark, 400, 5, "chunk_id")
    hot = x.select((F.col("chunk_id") + 1_000).alias("chunk_id"), F.transform(F.lit([1.0] * 8), lambda v: v).alias("_one")).join(
        x.select((F.col("chunk_id") + 1_000).alias("chunk_id"), "embedding"), "chunk_id").select(
        "chunk_id", F.zip_with("embedding", "_one", lambda a, b: (a * 0.1 + b).cast("float")).alias("embedding"))
    index = CellIndex(spark, str(tmp_path / "cells"))
    index.build(x.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")), n_cells=12)
    index.append(hot)
    before = index.sizes()
    split = index.split(3.0)
    after = index.sizes()
    assert split and not set(split) & set(after) and len(after) == len(before) + len(split) and sum(after.values()) == sum(before.values()) == 800
    every = x.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).unionByName(hot)
    q = _vectors(spark, 10, 6, "query_id")
    want = {(r.query_id, r.chunk_id) for r in vectors.knn(q, every, 7).collect()}
    assert {(r.query_id, r.chunk_id) for r in index.search(q, 7, probes=99).collect()} == want


def test_bm25_matches_definition(spark):
    import math

    texts = {1: "a b b c", 2: "a a d", 3: "a e f", 4: ""}
    df = spark.createDataFrame([(9, i, t, "a b zz b") for i, t in texts.items()], "query_id long, chunk_id long, text string, query_text string")
    got = {r.chunk_id: r.bm25 for r in ranking.bm25(df, ["query_id"], "chunk_id").collect()}
    docs = {i: t.split() for i, t in texts.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    vocab = {w for d in docs.values() for w in d}
    freq = {w: sum(w in d for d in docs.values()) for w in vocab}
    idf = {w: math.log(n - f + .5) - math.log(f + .5) for w, f in freq.items()}
    eps = .25 * sum(idf.values()) / len(idf)
    idf = {w: eps if v < 0 else v for w, v in idf.items()}
    for i, d in docs.items():
        want = sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (.25 + .75 * len(d) / avg)) for w in "a b zz b".split())
        assert abs(got[i] - want) < 1e-8


def _brute_search(rows, docs, fetch):
    """(question, key, place) by shared words over all pairs; ``rows``: (question, words, scopes), ``docs``: (key, scope, words)."""
    want = set()
    for q, ws, scopes in rows:
        hits = [(-len(set(ws) & set(d)), k) for k, scope, d in docs if scope in scopes and set(ws) & set(d)]
        want |= {(q, k, n + 1) for n, (_, k) in enumerate(sorted(hits)[:fetch])}
    return want


@pytest.mark.parametrize("seed", range(3))
def test_word_index_against_all_pairs(spark, tmp_path, seed):
    """Words from very frequent to unique, questions of one to nine words, blocks of a few keys, two appends."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: list({words[min(59, int(rng.expovariate(0.12)))] for _ in range(n)})
    docs = [(f"k{rng.randint(0, 10**6)}-{i}", rng.choice("abc"), [*pick(rng.randint(0, 12)), *(["all"] if rng.random() < 0.9 else [])]) for i in range(600)]
    index = WordIndex(spark, str(tmp_path / "index"), "key", "scope")
    kind = "key string, scope string, words array<string>"
    assert index.search(spark.createDataFrame([(1, ["all"], ["a"])], "q long, words array<string>, scopes array<string>"), ["q"], 3).count() == 0
    assert index.append(spark.createDataFrame(docs[:400], kind), block=50) == 400
    assert index.append(spark.createDataFrame([*docs[200:], (None, "a", ["w1"]), docs[500]], kind), block=50) == 200  # known keys are left out
    assert index.append(spark.createDataFrame(docs[:10], kind)) == 0 and len(index.segments()) == 2
    rows = [(i, pick(rng.randint(1, 9)) + (["all"] if i % 2 else []) + (["none"] if i % 5 == 0 else []), rng.sample("abcd", rng.randint(1, 3))) for i in range(40)]
    rows += [(100, ["all"], ["a", "b", "c"]), (101, ["w1", "all"], ["b"]), (102, ["none"], ["a"]), (103, [], ["a"]), (104, words, ["a", "c"])]
    asked = spark.createDataFrame(rows, "q long, words array<string>, scopes array<string>")
    for fetch in (1, 6, 25):
        got = {(r.q, r.key, r.pos) for r in index.search(asked, ["q"], fetch).collect()}
        assert got == _brute_search(rows, docs, fetch)


def test_search_counts_few_keys_on_their_own_words(spark, tmp_path, monkeypatch):
    """Keys that the lists already read leave behind are not counted again, though the rarest words set a low mark."""
    docs = [(f"k{i:04d}", "a", [*[f"c{j}" for j in range(8) if i % (j + 2)], *(["rare"] if i % 12 == 0 else [])]) for i in range(1200)]
    rows = [(1, ["rare", *[f"c{j}" for j in range(8)]], ["a"]), (2, ["c0", "c1"], ["a"])]
    index = WordIndex(spark, str(tmp_path / "index"), "key", "scope")
    index.append(spark.createDataFrame(docs, "key string, scope string, words array<string>"))
    stored = {}

    def kept(df, label):
        stored[label] = materialise(df, label)
        return stored[label]

    monkeypatch.setattr(postings, "materialise", kept)
    asked = spark.createDataFrame(rows, "q long, words array<string>, scopes array<string>")
    assert {(r.q, r.key, r.pos) for r in index.search(asked, ["q"], 4).collect()} == _brute_search(rows, docs, 4)
    assert stored["candidates"].where("q = 1").count() < 800  # of 1,200


def test_search_words_equal_words_stripped_one_by_one(spark):
    texts = ['A "b" (c), d. e', ' "." \u2003x.y\u00a0(z) ', "", ".,", "ΑΣ. ΟΔΟΣ, İ", "a\n\tb\x85c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one_by_one = F.array_distinct(F.filter(F.transform(ranking.words("t"), lambda w: F.regexp_replace(w, '["(),.]', "")), lambda w: w != ""))
    assert df.where(~court_search.search_words(F.col("t")).eqNullSafe(one_by_one)).count() == 0


def test_passages_are_cut_down_before_their_text_moves(spark):
    """The passages of a few ids equal the view's, no exchange lies between a scan of texts and its cut, and references come without texts."""
    sf = "/root/testdata/sf0.001"
    whole = retrieval.view(spark, sf, "passages")
    ids = whole.select("chunk_id").where("chunk_id % 7 = 0")
    got = retrieval._passages_of(spark, sf, ids)
    assert got.exceptAll(whole.where("chunk_id % 7 = 0")).count() == 0 and got.count() == ids.count() > 0
    plan = got.select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2
    chunks = retrieval._referring(spark, sf)
    assert "text" not in chunks.columns
    rows = lambda df: sorted(r.ref for r in df.collect())
    assert rows(sections.reference_list(chunks)) == rows(sections.reference_list(whole, None, retrieval.X.SECTION_REF)) != []


def test_an_append_that_dies_is_not_read(spark, tmp_path):
    index = WordIndex(spark, str(tmp_path / "index"), "key", "scope")
    rows = spark.createDataFrame([("k1", "a", ["x"])], "key string, scope string, words array<string>")
    index.append(rows)
    rows.select(F.lit("k2").alias("key"), "scope", "words").write.parquet(f"{index.path}/segment-dead/docs")
    asked = spark.createDataFrame([(1, ["x"], ["a"])], "q long, words array<string>, scopes array<string>")
    assert [r.key for r in index.search(asked, ["q"], 5).collect()] == ["k1"]
    plan = index.blocks([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "IN (3,5)" in plan


def test_lexical_hits(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(30)]
    dec = spark.createDataFrame(
        [(str(i), " ".join(random.sample(words, 8)) + " the", "cut", "x" * 400 + f" far{i % 3}", "bia" if i % 2 else "ca9") for i in range(200)],
        "case_id string, case_name string, summary string, search_text string, court string")
    q = spark.createDataFrame([(i, " ".join(random.sample(words, 4)) + f" the far{i % 4}", ["one", "two"]) for i in range(9)], "query_id long, terms string, sides array<string>")
    docs = [(d.case_id, d.court, f"{d.case_name} {d.search_text}".split()) for d in dec.collect()]
    got = court_search.lexical_hits(q, court_search.decision_index(dec), "terms", {"one": ["bia"], "two": ["bia", "ca9"]}, 6).collect()
    for side, courts in (("one", ["bia"]), ("two", ["bia", "ca9"])):
        want = _brute_search([(r.query_id, r.terms.split(), courts) for r in q.collect()], docs, 6)
        assert {(r.query_id, r.case_id, r.pos) for r in got if r.side == side} == want


def test_chunk_rules(one):
    law = "Intro.\nClause 1.1 " + "x" * 60 + "\nSection 3 " + "y" * 60 + "\nClause 1.2 " + "z" * 60 + "\n§ 4 short"
    got = one({"t": law}, law_pieces("t"))
    assert [(p.section, p.clause) for p in got] == [("Section 3", "Clause 1.1"), ("Section 3", "Clause 1.2")]
    # one clause only: sections are used instead
    few = "Section 1 " + "a" * 60 + "Section 2 " + "b" * 60
    assert [p.section for p in one({"t": few}, law_pieces("t"))] == ["Section 1", "Section 2"]
    case = "dropped " + "border " + "q" * 60 + " Analysis " + "r" * 60
    assert [(p.block_type, p.text[:5]) for p in one({"t": case}, case_pieces("t"))] == [("ruling", "order"), ("opinion", "Analy")]
    paragraphs = "p" * 120 + "\n\n" + "short\n\n" + "s" * 101
    assert [p.block_type for p in one({"t": paragraphs}, case_pieces("t"))] == ["paragraph"] * 2


def test_packing_model(one):
    def model(text, limit):
        if len(text) <= limit:
            return [text]
        out, cur = [], ""
        for p in text.split("\n\n"):
            if len(cur) + len(p) > limit and cur:
                out, cur = [*out, cur.strip()], p
            else:
                cur += "\n\n" + p
        return [x for x in [*out, cur.strip()] if x]

    random.seed(3)
    for _ in range(20):
        t = "\n\n".join("x" * random.choice([0, 3, 20, 45, 90]) for _ in range(12))
        assert one({"t": t}, pack_paragraphs("t", 10)) == model(t, 40)


def test_null_keys_and_text_ids_keep_their_rows(spark):
    from lexloom.operators import crawl_state as CS

    rows = [("a1", None, "law"), ("a2", None, "law"), ("b1", "x", None), ("c9", "x", None)]
    df = spark.createDataFrame(rows, "document_id string, filename string, doc_type string")
    got = CS.mark_latest(CS.assign_versions(df), ["filename", "doc_type"]).orderBy("document_id").collect()
    assert [(r.document_id, r.version, r.is_latest) for r in got] == [("a1", 1, False), ("a2", 2, True), ("b1", 1, False), ("c9", 2, True)]
    pages = spark.createDataFrame([("p1", None, "t"), ("p2", None, "t"), ("p3", "u", "t")], "page_id string, url string, content string")
    none = spark.createDataFrame([], "url string, content_hash string, status string")
    kinds = {r.page_id: r.change_type for r in CS.detect_changes(pages, none).collect()}
    assert kinds == {"p1": "new", "p2": "unchanged", "p3": "new"}


def test_item_in_two_cells_counts_once(spark):
    from lexloom.operators.vectors import knn

    q = spark.createDataFrame([(1, [1.0, 0.0], ["a", "b"])], "query_id long, embedding array<double>, cells array<string>")
    x = spark.createDataFrame([(1, [1.0, 0.0], ["a", "b"]), (2, [1.0, 1.0], ["a", "b"]), (3, [0.0, 1.0], ["b"])], "chunk_id long, embedding array<double>, cells array<string>")
    assert [r.chunk_id for r in knn(q, x, 3).orderBy("dense_pos").collect()] == [1, 2, 3]


def test_every_document_of_a_scope_is_searched(spark):
    from lexloom.plans.retrieval import scope_members

    df = spark.range(200).selectExpr("'law' as doc_type", "'t' as topic", "id as document_id")
    assert scope_members(df).where("scope = 't'").count() == 200 and scope_members(df, 50).where("scope = 't'").count() == 50


def test_texts_are_read_back_one_per_document(spark, tmp_path):
    from lexloom.sources.documents import read_text_files, write_texts

    df = spark.createDataFrame([("a.txt", "one\ntwo"), ("b.txt", "three")], "filename string, text string")
    write_texts(df, str(tmp_path / "texts"))
    assert sorted(r.text.strip() for r in read_text_files(spark, str(tmp_path / "texts")).select("text").collect()) == ["one\ntwo", "three"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from lexloom.session import scratch_base

    conf = lambda **kv: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: kv.get(k.replace(".", "_"), d)))
    assert scratch_base(conf(spark_checkpoint_dir="s3://x/y/")) == "s3://x/y"
    assert scratch_base(conf(spark_master="local[4]", spark_sql_warehouse_dir="file:/w")) == "file:/w/_scratch"
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_base(conf(spark_master="spark://host:1"))


def test_refreshed_mappings_follow_the_change(spark):
    """Kept, added, moved and retracted mappings; a reference that waits is compared with the added chunks only."""
    unit = lambda a: [float(np.cos(a)), float(np.sin(a))]
    chunk = "chunk_id long, embedding array<float>, section string, doc_version string"
    law = lambda rows: spark.createDataFrame([(i, unit(a), f"s{i}", "1") for i, a in rows], chunk)
    vecs = spark.createDataFrame([(r, unit(a)) for r, a in (("keeps", 0.0), ("moves", 1.0), ("ends", 2.2), ("waits", 3.0), ("new", 0.1), ("far", 4.5), ("absent", 0.0))], "ref string, embedding array<float>")
    refs = lambda *names: spark.createDataFrame([(n,) for n in names], "ref string")
    first = law([(1, 0.0), (2, 1.05), (3, 2.2)])
    before = sections.map_sections(refs("keeps", "moves", "ends", "waits", "far"), vecs, first)
    assert {(r.old_section_ref, r.current_chunk_id) for r in before.collect()} == {("keeps", 1), ("moves", 2), ("ends", 3)}
    now = law([(1, 0.0), (4, 0.7), (5, 3.1)])  # 2 and 3 were replaced
    got = sections.refresh_mappings(before, refs("keeps", "moves", "ends", "waits", "far"), refs("keeps", "moves", "ends", "waits", "far", "new", "new", "unknown"), vecs, now, now.where("chunk_id > 3"))
    assert sorted((r.old_section_ref, r.current_chunk_id, r.change) for r in got.collect()) == [
        ("ends", 3, "retracted"), ("keeps", 1, "kept"), ("moves", 4, "moved"), ("new", 1, "added"), ("waits", 5, "added")]


def test_left_join_spreads_a_frequent_key(spark):
    left = spark.createDataFrame([(i, -1 if i % 4 else i % 40) for i in range(8000)] + [(9000 + i, None) for i in range(3000)], "id long, k long")
    right = spark.createDataFrame([(-1, "a"), (-1, "b"), (0, "c"), (4, "d"), (None, "e"), (77, "f")], "k long, v string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = skew.spread_left_join(left, right, "k", F.col("id"), most=500)
        rows = sorted(got.select("id", "k", "v").collect(), key=str)
        tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == sorted(left.join(right, "k", "left").select("id", "k", "v").collect(), key=str)
    assert max(t["count"] for t in tasks) < 0.4 * len(rows)  # a plain join has 12,000 of the 17,000 rows in one task
