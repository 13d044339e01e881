"""Piece ids against the sentencepiece library, with chunks of any size."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import documents

from lexloom.llm import queries
from lexloom.llm import sentencepiece_scan as scan

PATH = public_tokenizers.path("piece_bpe_32k.model")
PLAIN = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "b", "the", "ing", " ", "  ", "é", "漢", "\n", "🙂", "0", "1", '."', "tion", "x", "\t", "<0x0A>", "<s>"]


@pytest.fixture(scope="module")
def model():
    return scan.load(PATH)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS if k % 2 else list("abcdetinrs")) for _ in range(rng.randint(0, 90))) for k in range(n)]


def test_whole_texts(model):
    for t in [*texts(1, 300), "▁▁ a▁", " ", "   "]:
        ids = PLAIN.encode(t)
        assert np.frombuffer(model.encode(t), "<i4").tolist() == ids, repr(t)
        assert model.decode(ids) == PLAIN.decode(ids)


@pytest.mark.parametrize("chunk", [16, 23, 64])
def test_chunks_and_fan(spark, model, monkeypatch, chunk):
    monkeypatch.setattr(scan, "FAN", 3)
    rows = [(i, t) for i, t in enumerate(texts(chunk, 60))]
    rows += [(100, None), (101, ""), (102, "a" * 700), (103, "word " * 200), (5, rows[5][1]), (None, "no id, but a text of some length")]
    encoded = scan.encode(documents(spark, rows).repartition(3), model, chunk=chunk)
    got = scan.whole(encoded).collect()
    key = lambda d, ids: (d is not None, d or 0, list(ids))
    assert sorted(key(r.doc_id, np.frombuffer(r.ids, "<i4").tolist()) for r in got) == sorted(key(d, PLAIN.encode(t or "")) for d, t in rows)
    back = scan.decode(scan.whole(encoded), model).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in back) == sorted((d is not None, d or 0, t or "") for d, t in rows)


def test_piece_scores(spark, monkeypatch):
    """A model of piece scores: the best path by plain dynamic programming, over any chunks."""
    rng = random.Random(3)
    pieces = {"a": -2.0, "b": -2.1, "ab": -2.5, "ba": -2.7, "aba": -3.9, "bb": -3.3, "▁": -1.5, "▁a": -2.2, "abab": -5.0}
    names = ["<unk>", *pieces]
    m = scan.Model(dict(pieces), {p: i + 1 for i, p in enumerate(pieces)}, [n.encode() for n in names], None, 0, False)
    monkeypatch.setattr(scan, "FAN", 2)
    rows = [(i, "".join(rng.choice("ababab ") for _ in range(rng.randint(20, 80))).strip()) for i in range(20)]
    weigh = lambda ids: sum(m.weight(names[i]) for i in ids)
    for r in scan.whole(scan.encode(documents(spark, rows), m, chunk=7)).collect():
        ids, text = np.frombuffer(r.ids, "<i4").tolist(), "▁" + dict(rows)[r.doc_id].replace(" ", "▁")
        assert "".join(names[i] for i in ids) == text
        assert weigh(ids) == pytest.approx(sum(m.weight(t) for t in m.best_path(text)))


def test_products_combine_in_any_order():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, rng.normal(size=(4, 4)), -np.inf) for _ in range(3))
    assert np.allclose(scan.product(scan.product(a, b), c), scan.product(a, scan.product(b, c)))


def test_digest_and_empty(spark, model):
    got = queries.encoded_digest(documents(spark, [(1, "one two"), (2, None)]), model).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_ids, r.n_chars) for r in got] == [(1, len(PLAIN.encode("one two")), 7), (2, 0, 0)]
    assert queries.encoded_digest(documents(spark, []), model).count() == 0


def test_words_are_kept_once_and_long_ones_not():
    m = scan.load(PATH)
    rows = ["word, word. word!", "漢字" * 5000 + " " + "x" * 5000, "word " * 3 + "a" * 300]
    assert [np.frombuffer(m.encode(t), "<i4").tolist() for t in rows] == [PLAIN.encode(t) for t in rows]
    kept = [*m.words, *m.known]
    assert max(map(len, kept)) <= 256 and not {scan.SPACE + "word"} & set(kept)
    m.words.limit = 2
    for t in ("a b c d e f a b", "b c, d a"):
        assert np.frombuffer(m.encode(t), "<i4").tolist() == PLAIN.encode(t)
    assert len(m.words) <= 2 and len(m.words.before) <= 2
