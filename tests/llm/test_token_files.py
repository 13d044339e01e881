"""Token files against direct encoding, random access, damage and edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import token_files as tf

VOCABULARY = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
PLAIN = Tokenizer.from_buffer(VOCABULARY)
ENCODER = tf.Encoder(VOCABULARY, 2)


def direct(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t'sß　漢🙂1.#\xa0  ", max_size=40))
def test_pieces_equal_whole_text(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == direct(text)


@pytest.mark.parametrize("text", ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>\n c", "no <|endoftext |> token"])
def test_added_tokens_equal_whole_text(text):
    got = ENCODER.encode(["plain words", text, "", "plain again"])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [direct(t) for t in ("plain words", text, "", "plain again")]


def test_long_pieces_are_not_kept():
    """Texts without spaces would fill the tables with whole texts."""
    texts = ["漢字" * 5000, "word " + "x" * 5000, "word, word! naïve-word's ñandú", "ab" * 128 + " " + "é" * 256]
    e = tf.Encoder(VOCABULARY, 2)
    assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(texts)] == [direct(t) for t in texts]
    assert max(len(p) for table in (e.first, e.rest) for p in table) <= 256


def test_tables_turn_over():
    e = tf.Encoder(VOCABULARY, 2, limit=6)
    texts = ["a b c d, e\n f  g", "b c d e, f naïve", "  a  b", "d c b a 漢字 x", "", " "] * 3
    assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(texts)] == [direct(t) for t in texts]
    assert len(e.first) + len(e.rest) <= 6


def test_write_and_read(spark, tmp_path):
    rows = [(5, "Some text here", "x"), (1, None, "x"), (3, "", "y"), (None, "no id", "z"), (9, "word " * 300_000, "x"), (5, "Some text here", "x"), (-2, "don't  stop \n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = tf.write_tokens(docs.repartition(3), VOCABULARY, 2, str(tmp_path / "files"))
    got = tf.read_files(manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((d is not None, d or 0, direct(t)) for d, t, _ in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, -2, 1, 3, 5, 5, 9]
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered[:-1])]).tolist()
    crc = {r.doc_id: r.ids_crc32 for r in tf.read_files(manifest, digest=True).collect()}
    assert crc[9] == zlib.crc32(np.array(direct(rows[4][1]), "<u4").tobytes())
    path = manifest.orderBy(F.desc("documents")).first().path
    f = tf.TokenFile(path)
    some = tf.read_files(manifest, wanted=spark.createDataFrame([(path, [0])], "path string, rows array<int>")).collect()
    assert len(some) == 1 and some[0].ids == f.ids(0).tolist()


def test_many_frames_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 10)
    ids = np.arange(25, dtype="<u4").tobytes()
    body, packed, sizes, checks = tf.pack(ids)
    assert sizes == [40, 40, 20]
    index = np.array([(7, False, 0, 3, 25)], tf.INDEX_ENTRY)
    seek = np.array(list(zip(packed, sizes, checks, strict=True)), tf.SEEK_ENTRY)
    good, bad = tmp_path / "a", tmp_path / "b"
    good.write_bytes(body + tf.tail(index, seek))
    assert tf.TokenFile(str(good)).ids(0).tobytes() == ids
    seek["check"][1] += 1
    bad.write_bytes(body + tf.tail(index, seek))
    with pytest.raises(ValueError, match="checksum"):
        tf.TokenFile(str(bad)).ids(0)
    with pytest.raises(ValueError, match="seek table"):
        good.write_bytes(body + b"0" * 20)
        tf.TokenFile(str(good))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.read_files(tf.write_tokens(docs, VOCABULARY, 2, str(tmp_path / "none")), digest=True).count() == 0
