"""Alignment against a byte by byte version with the two libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, sentence
from pyspark.sql import functions as F

from lexloom.llm import alignment


def _read(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


ONE, TWO = _read("byte_bpe_50k.json"), _read("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_buffer(ONE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=TWO)


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts, libraries):
    """Per text: ids with byte ranges, groups, links; then the corpus-wide figures."""
    a, sp = libraries
    back = {c: b for c, b in alignment._alphabet().items()}
    rows = []
    for t in texts:
        rows.append(([], [], [], []))
        if not t:
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        pa_ = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        pb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(pa_) != (" " + t).encode() or b"".join(pb) != (" " + t).encode():
            continue
        sa, sb = spans(pa_), spans(pb)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, at = [], 0
        for c in cuts:
            groups.append(([i for i, (s, e) in zip(ia, sa, strict=True) if at < e <= c], [i for i, (s, e) in zip(ib, sb, strict=True) if at < e <= c], at, c))
            at = c
        links = [(i, j) for i, (s, e) in zip(ia, sa, strict=True) for j, (u, v) in zip(ib, sb, strict=True) if s < v and u < e]
        rows[-1] = (ia, ib, groups, links)
    count = Counter(p for r in rows for p in r[3])
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    out = []
    for ia, ib, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _, _ in groups)
        out.append((len(ia), len(ib), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, [r[2] for r in rows]


def odd_texts():
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(1, 40)) for _ in range(40)]
    texts += [
        None, "", " ", "   ", "a", "\n", "\t\n x", "<|endoftext|> and </s> <s> <unk> <0x41>", "▁", "one▁two", "漢字かな交じり文 and العربية и кириллица",
        "é́ñ ß ﬁ ｆｕｌｌ", "😀😃 family 👨‍👩‍👧", "​﻿ x", "x\u0000y", "1234567890 3.14 !!!??", "don't we'll I'M", "  two  spaces   and\n\n\nlines \r\n", "naïve café", "ZZZZ" * 50,
    ]
    for alphabet, n in (("ab cé漢😀\n <|>'.0", 110), ("ab c ▁", 10)):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return texts + [texts[0]] * 3


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("limit", [alignment.LIMIT, 0])
def test_agreement(spark, libraries, limit):
    texts = odd_texts()
    want, _ = brute(texts, libraries)
    assert sum(w[0] > 0 for w in want) > 100 and sum(w[0] == 0 for w in want) > 4
    got = alignment.agreement(documents(spark, list(enumerate(texts))).repartition(3), ONE, TWO, limit=limit)
    assert got.columns == ["doc_id", *COLUMNS]
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == want


def test_groups(spark, libraries):
    texts = odd_texts()
    _, want = brute(texts, libraries)
    rows = {r.doc_id: [(list(g.a), list(g.b), g.start, g.end) for g in r.groups] for r in alignment.groups(documents(spark, list(enumerate(texts))), ONE, TWO).collect()}
    assert [rows[i] for i in range(len(texts))] == want


def test_repeated_and_null_ids_and_empty_table(spark):
    df = documents(spark, [(None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, None)])
    for limit in (alignment.LIMIT, 0):
        rows = sorted(alignment.agreement(df, ONE, TWO, limit=limit).select("doc_id", "n_a", "count_sum").collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
        assert [r.doc_id for r in rows] == [None, 4, 4, 5] and len({tuple(r)[1:] for r in rows[:3]}) == 1 and rows[3].n_a == 0
        assert alignment.agreement(df.limit(0), ONE, TWO, limit=limit).count() == 0


def test_very_long_text(spark, libraries):
    long = " ".join(sentence(random.Random(7), 40) for _ in range(2_000))
    got = alignment.agreement(documents(spark, [(1, long), (2, "short")]), ONE, TWO).where("doc_id = 1").first()
    a, sp = libraries
    assert got.n_a == len(a.encode(" " + long, add_special_tokens=False).ids) and got.n_b == len(sp.encode(long))
    assert got.n_links == got.n_a + got.n_b - got.n_groups


def test_sides_give_the_libraries_ids(libraries):
    a, sp = libraries
    one, two = alignment.byte_level(ONE), alignment.word_pieces(TWO)
    rng = random.Random(11)
    marks = ["a", "B", "é", "7", "½", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "\u2003", "\u3000", "'s", "'", "!", "\u0301", "漢", "😀", "\u200d", "İ", "<s>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 25))) for _ in range(4_000)] + odd_texts()[40:]
    texts += ["x" * 200_000, " " * 200_000 + "y", "a" + "\n" * 2_000_000 + "b", " " * 9_990 + "\n\t a", "!?" * 100_000, "ab " * 100_000, "é" * 50_000]
    texts = [t for t in texts if t]
    assert [x.tolist() for x in one.encode(texts)] == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in two.encode(texts)] == sp.encode(texts)


def test_shared_cuts_random():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        docs = np.sort(rng.choice(n, int(rng.integers(0, min(5, n))), replace=False)) + 1
        ends = [np.union1d(np.union1d(np.flatnonzero(rng.random(n) < p) + 1, docs), [n]) for p in rng.random(2)]
        starts = [np.concatenate([[0], np.searchsorted(e, np.union1d(docs, [n])) + 1]) for e in ends]
        x, y = alignment.shared_cuts(*ends, *starts)
        want = np.intersect1d(*ends)
        assert (ends[0][x] == want).all() and (ends[1][y] == want).all()
    none = np.zeros(0, np.int64)
    assert [len(v) for v in alignment.shared_cuts(none, none, np.zeros(3, np.int64), np.zeros(3, np.int64))] == [0, 0]


def test_counts_handed_on_early(spark):
    counted = alignment._counted(documents(spark, [(i, f"alpha beta {i}") for i in range(50)]).repartition(2), ONE, TWO, "doc_id", "text")
    rows = [sorted(map(tuple, alignment.pair_counts(counted, False, flush=f).collect())) for f in (1, alignment.FLUSH)]
    assert rows[0] == rows[1] and counted.agg(F.sum("n_links")).first()[0] == sum(n for _, n in rows[0])


def test_query(spark, libraries):
    from lexloom.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: tuple(r)[1:] for r in queries.op11_shared_cuts(spark, sf).select("doc_id", *COLUMNS).collect()}
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: len(r.text or ""))[:80]
    some = alignment.agreement(documents(spark, [(r.doc_id, r.text) for r in docs]), ONE, TWO)
    want, _ = brute([r.text for r in docs], libraries)
    assert [tuple(r)[1:] for r in sorted(some.collect(), key=lambda r: [d.doc_id for d in docs].index(r.doc_id))] == want
    assert [(*rows[d.doc_id][:4], rows[d.doc_id][6]) for d in docs] == [(*w[:4], w[6]) for w in want]
    assert all(0 < best <= links <= total for _, _, _, links, best, total, _ in rows.values())
