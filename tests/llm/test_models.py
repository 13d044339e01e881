"""Classifiers and the language model on small corpora with known answers."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, sentence
from pyspark.sql import functions as F

from lexloom.llm import mixing_lm, quality, toxicity
from lexloom.llm.common import arrays_of, remainder

BAD = ["vilefool", "nastyrat", "dumbox"]


def corpus(seed=0, n=600):
    rng = random.Random(seed)
    rows, toxic, junk = [], {}, {}
    for d in range(n):
        words = sentence(rng, rng.randint(5, 80)).split()
        toxic[d], junk[d] = rng.random() < 0.15, rng.random() < 0.3
        if toxic[d]:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ish", "."]))
        if junk[d]:
            words = [w + "###" for w in words]
        rows.append((d, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, "word " * 40_000), (3, rows[3][1])]
    return rows, toxic, junk


def labels(spark, toxic, junk):
    rows = [(d, int(not junk[d]), int(toxic[d])) for d in toxic if d % 2 == 0] + [(None, 1, 1), (1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def split(score, truth, rows):
    got = {d: score[d] for d, _ in rows if d in truth}
    return [s for d, s in got.items() if truth[d]], [s for d, s in got.items() if not truth[d]]


def test_toxicity_trains_without_a_dense_sample():
    rng = np.random.default_rng(1)
    shown = [np.unique(rng.integers(0, 4096, rng.integers(0, 40))) for _ in range(3_000)]
    label = (np.arange(3_000) % 30 == 0).astype(np.int64)
    s = toxicity.Settings(members=2, steps=20, batch=64)
    tracemalloc.start()
    w, b = toxicity.train(shown, label, 4096, 0.1, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.shape == (2, 4096) and np.isfinite(w).all() and np.isfinite(b).all() and w.any()
    assert peak < 20e6, peak  # the dense sample alone has 49 MB
    rows, dense = toxicity._Rows(shown, 4096, 8), np.zeros((3_000, 4096))
    for i, f in enumerate(shown):
        dense[i, f] = 1
    for _ in range(5):
        docs = rng.choice(3_000, rng.integers(1, 9), replace=False)
        assert (rows.of(docs) == dense[docs]).all()


def test_arrays_of(spark):
    df = spark.range(1_000, numPartitions=7).selectExpr("cast(id as int) as a", "id * 5000000000 as b", "'x' as c")
    got = arrays_of(df, {"a": "<i4", "b": "<i8"})
    order = np.argsort(got["a"])
    assert (got["a"][order] == np.arange(1_000)).all() and (got["b"][order] == np.arange(1_000) * 5_000_000_000).all()
    assert {c: len(v) for c, v in arrays_of(df.where("a < 0"), {"a": "<i4"}).items()} == {"a": 0}


def test_toxicity(spark):
    rows, toxic, junk = corpus()
    docs = documents(spark, rows)
    model = toxicity.fit(docs.repartition(3), labels(spark, toxic, junk), remainder(F.col("doc_id"), 3) != 1)
    out = toxicity.score(docs, model)
    assert set(out.columns) == set(docs.columns) and out.count() == len(rows)
    score = {r.doc_id: r.score for r in out.collect()}
    held = {d for d in toxic if zlib.crc32(str(d).encode()) % 3 == 1}
    bad, good = split({d: score[d] for d in score}, {d: toxic[d] for d in held}, rows)
    assert np.mean(np.array(bad) >= 0.7) > 0.8 and np.mean(np.array(good) >= 0.7) < 0.02
    assert score[600] == score[601] and all(0 <= s <= 1 for s in score.values())
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs.repartition(5), labels(spark, toxic, junk), remainder(F.col("doc_id"), 3) != 1)).collect()}
    assert max(abs(again[d] - score[d]) for d in score) < 1e-9


def test_risk_stays_non_negative_with_positives_among_unlabelled():
    """Unlabelled texts that show the toxic feature do not push its weight below the threshold."""
    shown = [np.array([0])] * 60 + [np.array([0])] * 60 + [np.array([], np.int64)] * 500
    label = np.array([1] * 60 + [0] * 560)
    w, b = toxicity.train(shown, label, 1, 0.1, toxicity.Settings(members=1, steps=400))
    assert w[0, 0] + b[0] > 1 and b[0] < -1


def test_quality(spark):
    rows, toxic, junk = corpus(1)
    docs = documents(spark, rows)
    model = quality.fit(docs.repartition(3), labels(spark, toxic, junk), remainder(F.col("doc_id"), 4) != 2)
    score = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = {d: not junk[d] for d in junk if zlib.crc32(str(d).encode()) % 4 == 2}
    good, bad = split(score, held, rows)
    assert np.mean(np.array(good) >= 0.7) > 0.95 and np.mean(np.array(bad) >= 0.7) < 0.05
    assert score[600] == score[601] and len(score) == 603
    text = rows[5][1]
    b, t = quality.buckets(text)
    assert quality.Features(model.adds).logit(text) == pytest.approx(float((model.adds[b] * t).sum() / t.sum()))


def test_no_labels_and_no_documents(spark):
    docs, none = documents(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()] == pytest.approx([0, 0], abs=1e-9)
    assert [r.score for r in quality.score(docs, quality.fit(docs, none, F.lit(True))).collect()] == [0.5, 0.5]
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, none, F.lit(True))).count() == 0
    assert quality.score(empty, quality.fit(empty, none, F.lit(True))).count() == 0
    assert mixing_lm.score(empty, F.lit(False)).count() == 0


def test_language_model(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(d, sentence(rng, rng.randint(3, 60)) + rng.choice(["", " unseen" + str(d)])) for d in range(300)]
    rows += [(400, None), (401, " \t"), (402, "Word " * 20_000), (7, rows[7][1]), (None, "alpha beta")]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    monkeypatch.setattr(mixing_lm, "BUNDLE", 4_000)
    got = mixing_lm.score(documents(spark, rows).repartition(3), remainder(F.col("doc_id"), 7) == 2).collect()
    words = [(d, [w.lower() for w in (t or "").split()]) for d, t in rows]
    count, ends = Counter(w for d, ws in words if not held(d) for w in ws), sum(not held(d) for d, _ in words)
    n, v = sum(count.values()) + ends, len(count) + 1
    base = {d: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1)) for d, ws in words}
    assert len(got) == len(rows)
    for r in got:
        ws = dict(words)[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n)
        assert r.base_score == pytest.approx(base[r.doc_id]) and r.score < 0
    assert sum(r.score for r in got if r.held_out) > 1.1 * sum(r.base_score for r in got if r.held_out)


def test_word_probabilities_sum_to_one():
    """All continuations of a prefix share what the prefix leaves: the 256 one-byte words of an untrained model."""
    m = mixing_lm.Mixer(np.zeros((int(mixing_lm.OFFSETS[-1]), 2), np.uint16))
    counts = np.random.default_rng(1).integers(0, 50, (2, *m.tables.shape)).astype(np.uint32)
    m.tables = counts[0] | counts[1] << np.uint32(16)
    words = [bytes([b]) for b in range(256) if b != 32]
    slots = m.logs([b""], np.zeros(1, np.int64))  # the space itself
    first = 10 ** slots[0]
    z = m.predict(words, np.zeros(len(words), np.int64))
    p = 1 / (1 + np.exp(-z[2]))
    one = np.where(z[3] == 1, p, 1 - p).reshape(len(words), 2, 8).prod(axis=2)[:, 0]
    z = m.predict([b""], np.zeros(1, np.int64))
    p = 1 / (1 + np.exp(-z[2]))
    space = np.where(z[3] == 1, p, 1 - p).prod()
    assert one.sum() + space == pytest.approx(1) and 0 < first < 1


def test_classes_tell_languages_apart():
    rng = np.random.default_rng(2)
    pairs = np.zeros((mixing_lm.TAILS, mixing_lm.TAILS))
    for low in (0, 30):
        for _ in range(20_000):
            a, b = rng.integers(low, low + 30, 2)
            pairs[a, b] += 1
    ends = mixing_lm.classes_of(pairs)
    text = np.concatenate([rng.integers(0, 30, 50), rng.integers(30, 60, 50)])
    cls = mixing_lm.running_class(text, np.arange(100), ends)
    assert not set(cls[5:50]) & set(cls[60:])


def test_classes_of_a_bundle_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    ends = np.log(rng.dirichlet(np.ones(mixing_lm.TAILS), mixing_lm.CLASSES).T)

    def brute(tail, start):
        return [int(sum(ends[tail[i - k]] for k in range(1, min(4, start[i]) + 1)).argmax()) if start[i] else 0 for i in range(len(tail))]

    tail, start = rng.integers(0, mixing_lm.TAILS, 300), np.concatenate([np.arange(n) for n in rng.integers(1, 9, 300)])[:300]
    for block in (1, 2, 5, 64, 1000):
        assert mixing_lm.running_class(tail, start, ends, block).tolist() == brute(tail, start)
    n = 600_000
    tracemalloc.start()
    mixing_lm.running_class(rng.integers(0, mixing_lm.TAILS, n), np.tile(np.arange(500), n // 500), ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # 8 numbers a word for the whole bundle would be 115 MB and more


def test_context_tables_leave_the_worker_after_the_scores():
    import pyarrow as pa
    import zstandard

    from lexloom.llm import mixing_lm as M

    pack = zstandard.ZstdCompressor(level=1).compress
    packed = pa.table({"range": [0], "bundle": [7], "pos": [pack(np.array([0, 1], np.uint32).tobytes())], "words": [pack(b"a b")], "cls": [pack(bytes([1, 0]))]})
    logs = np.arange(2.0 * M.CLASSES).reshape(2, -1)
    scored = pa.table({"word": pa.array([b"b", b"a"], pa.binary()), "c": [3, 4], "logs": list(logs)})
    M._TABLES[b"key"] = np.zeros((4, 2), np.uint16)
    got = M._answered((pa.scalar(0),), packed, scored)
    assert not M._TABLES
    assert np.frombuffer(got["log"][0].as_py()).tolist() == [logs[1, 1], logs[0, 0]] and M._unpack(got["c"][0], np.int64).tolist() == [4, 3]


def test_fronts_that_words_share_are_predicted_once():
    rng = np.random.default_rng(4)
    m = mixing_lm.Mixer(rng.integers(0, 60, (int(mixing_lm.OFFSETS[-1]), 2)).astype(np.uint16))
    m.weights[:, :-1] = rng.normal(0.2, 0.1, (mixing_lm.GATES, mixing_lm.K))
    m.seen[:] = rng.integers(0, 9, m.seen.shape)
    words = [b"", b"un", b"under", b"under", b"undo", b"v" * 70_000, b"v" * 70_001, b"under", b"", b"a", b"undo"]
    cls = np.array([0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1])
    alone = [m.logs([w], cls[i : i + 1])[0] for i, w in enumerate(words)]
    assert m.logs(words, cls) == pytest.approx(alone, rel=1e-12)
    n_bytes = sum(len(w) + 1 for w in words)
    # 1 + 3 + 4 + 0 + 2 + 70,001 + 2 bytes of the first class, 6 + 1 + 2 + 5 of the other
    assert mixing_lm.contexts(words, cls)[0].shape == (mixing_lm.K, 8 * 70_027) and n_bytes > 140_000
    counts = rng.integers(1, 9, len(words))
    before = m.seen.sum()
    m.learn(words, cls, counts, 0.1)
    assert m.seen.sum() - before == 8 * sum(c * (len(w) + 1) for c, w in zip(counts.tolist(), words, strict=True))


def test_parts_of_a_batch_hold_every_counted_class_once():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    words = [w.encode() for w in sorted({sentence(random.Random(i), 1) + str(i % 7) for i in range(200)}, key=lambda w: w[::-1])]
    table = rng.integers(0, 3, (len(words), mixing_lm.CLASSES)) * rng.integers(0, 2, (len(words), 1))
    b = {"word": pa.array(words, pa.binary()), "taught": pa.array(list(table))}
    for ordered in (False, True):
        got = Counter()
        for ws, z, c, i in mixing_lm._batches(b, "taught", 300, ordered=ordered):
            assert ws == [words[k] for k in i.tolist()] and list(zip(z.tolist(), ws, strict=True)) == sorted(zip(z.tolist(), ws, strict=True))
            got.update({(w, k): n for w, k, n in zip(ws, z.tolist(), c.tolist(), strict=True)})
        assert got == Counter({(w, k): int(table[i, k]) for i, w in enumerate(words) for k in range(mixing_lm.CLASSES) if table[i, k]})


def test_words_of_whole_batches():
    import pyarrow as pa

    from lexloom.llm.common import words_of

    texts = ["Ab  c\x0b\x0cD", None, "", " \t\r\n", "É x\x1cy İI\u0085 z ", "one", "\nLast\t", "x" * 70_000]
    for part in (texts, [], [None], [""], [" a"]):
        words, length = mixing_lm._flat(pa.array(part, pa.string()))
        assert words.to_pylist() == [w for t in part for w in words_of(t)] and length.tolist() == [len(words_of(t)) for t in part]
        assert len(mixing_lm.tails(words)) == len(words)
    words = pa.array([b"a", b"", b"ab", b"b", b"xab", b"\xc3\xa9", b"ab"], pa.binary())
    ends = mixing_lm.tails(words)
    assert ends[2] == ends[4] == ends[6] != ends[3] and mixing_lm.tails(words[2:5]).tolist() == ends[2:5].tolist()
    parts = list(mixing_lm._slices({"text": pa.array(texts)}, lambda: 10))
    assert [t for p in parts for t in p["text"].to_pylist()] == texts and len(parts) > 3


def test_word_numbers_travel_by_byte_and_small():
    ids = np.random.default_rng(3).geometric(0.001, 50_000).astype(np.uint32)
    ids[7] = 4_000_000_000
    blob = mixing_lm._planed(ids)
    assert mixing_lm._unplaned(blob).tolist() == ids.tolist() and len(blob) < 0.5 * ids.nbytes
    assert mixing_lm._unplaned(mixing_lm._planed(ids[:0])).tolist() == []
