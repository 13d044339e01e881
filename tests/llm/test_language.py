"""Language labels: the walk against all paths, spans of mixed texts, held-out languages."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import language, queries

SF = "/root/testdata/sf0.01"
STEMS = {"aa": "schen ung keit der und nicht ein", "bb": "ción mente los que una está", "cc": "привет мир слово большой", "dd": "日本 東京 漢字 かな"}


def text(rng, lang, n):
    return " ".join(rng.choice(STEMS[lang].split()) + rng.choice(["", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd"] * 12)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (1003, "der und", None), (None, text(rng, "aa", 9), "aa"), (1004, text(rng, "aa", 5), "zz"), (1004, text(rng, "aa", 5), "zz")]
    return spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, _text int")


@pytest.fixture(scope="module")
def model(table):
    return language.fit(table, F.coalesce(F.col("doc_id") < 1000, F.lit(False)))


def weight(e, labels, penalty):
    return e[np.arange(len(e)), labels].sum() - penalty * (np.diff(labels) != 0).sum()


def test_walk_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k, penalty = int(rng.integers(1, 7)), int(rng.integers(1, 4)), float(rng.choice([0.0, 0.5, 2.0, 12.0]))
        e = np.round(rng.normal(size=(n, k)) * 2, 1)
        best = max(weight(e, np.array(p), penalty) for p in itertools.product(range(k), repeat=n))
        for labels in (language.best_labels(e, penalty), language.viterbi(e, penalty)):
            assert weight(e, labels, penalty) == pytest.approx(best)


def test_spans_of_a_mixed_text(model):
    rng = random.Random(2)
    reader = language.Reader(model)
    parts = [("aa", text(rng, "aa", 25)), ("cc", text(rng, "cc", 8)), ("bb", text(rng, "bb", 20)), ("aa", text(rng, "aa", 12))]
    whole = "\n".join(p for _, p in parts)
    got = reader.spans(whole)
    assert [g["lang"] for g in got] == [name for name, _ in parts]
    at = 0
    for g, (_, p) in zip(got, parts, strict=True):
        assert (g["start"], g["end"]) == (at, at + len(p.rstrip(".,")))
        at += len(p) + 1
    assert reader.predict(whole)[0] == "aa"
    one = whole.replace(parts[1][1].split()[0], "der", 1)
    assert len(reader.spans(one)) == 4  # a single word changes nothing


def test_positions_count_in_the_given_text(model):
    reader = language.Reader(model)
    t = "İİ " + "schen ung keit nicht ein " * 3 + "привет мир слово большой " * 3
    got = reader.spans(t)
    assert got[-1]["lang"] == "cc" and t[got[-1]["start"] : got[-1]["end"]] == ("привет мир слово большой " * 3).strip()


def test_scripts_narrow_the_candidates(model):
    assert model.languages == ["aa", "bb", "cc", "dd"]
    names = {w: language.SCRIPTS[language.script(w)] for w in ("abc", "слово", "漢字かな", "かなな", "اب", "é", "𐍈")}
    assert names == {"abc": "Latin", "слово": "Cyrillic", "漢字かな": "Han", "かなな": "Hiragana", "اب": "Arabic", "é": "Latin", "𐍈": "other"}
    p = np.exp(model.score(["слово", "ung", "ζωη"]))
    assert p[0].round(2).tolist() == [0.0, 0.0, 1.0, 0.0] and p[1].argmax() == 0 and p[1, 2] < 0.01
    assert (p[2] > 0.0).all()  # a script of no language leaves all


def test_defined_cases(spark, table, model):
    rows = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(table, model).collect()]
    assert len(rows) == table.count()
    by_id = {d: (p, s) for d, p, s in rows}
    assert by_id[1000] == by_id[1001] == by_id[1002] == ("und", 0.0)
    assert by_id[1003][0] == "aa" and by_id[None][0] == "aa" and sum(d == 1004 for d, _, _ in rows) == 2
    assert all(0.0 <= s <= 1.0 for _, _, s in rows)
    assert {r.doc_id: r.spans for r in language.spans(table, model).collect()}[1000] == []
    empty = language.fit(table.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.predict(table, empty).collect()} == {("und", 0.0)}
    assert language.predict(table.limit(0), model).count() == 0


def test_long_runs_and_long_texts(spark, model):
    reader = language.Reader(model)
    assert max(map(len, language.words("a" * 100 + " " + "漢" * 1000))) == language.LONGEST
    long = text(random.Random(4), "bb", 60_000) + " " + text(random.Random(4), "cc", 40_000)
    assert [s["lang"] for s in reader.spans(long)] == ["bb", "cc"] and reader.predict(long)[0] in ("bb", "cc")


def test_sample_is_bounded_by_language(table):
    few = language.fit(table, F.lit(True), sample=1)
    assert few.languages == ["aa", "bb", "cc", "dd", "zz"]


def test_query_on_held_out_documents(spark):
    got = queries.op12_language_spans(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    held = docs.select("doc_id", "lang").join(got, "doc_id").where("held_out")
    right, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98
    assert held.where("lang_pred <> 'en'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
