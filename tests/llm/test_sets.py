"""Components, and the n-gram join against brute force."""

import random

import pytest
from helpers import documents, groups, sentence

from lexloom.llm import jaccard
from lexloom.llm.components import components


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (7, 8), (8, 7)]
    want = {n: g for n, g in groups({x for p in links for x in p}, links).items() if any(a != b and n in (a, b) for a, b in links)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, n, percent, monkeypatch):
    rng = random.Random(n)
    rows = [(i, sentence(rng, rng.randint(1, 80))) for i in range(100)]
    base = sentence(rng, 120).split()
    for i in range(100, 190):  # a group of near copies, some beyond the threshold of each other
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 99))
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "One"), (205, "one two"), (205, "one two"), (7, rows[7][1]), (206, "word " * 30_000), (207, "WORD " * 29_000), (208, "nb\xa0sp x"), (None, "one two")]
    monkeypatch.setattr(jaccard, "LONG", 16)  # lists in several blocks
    got = jaccard.similar_documents(documents(spark, rows).repartition(4), n, percent).collect()
    sets = {d: shingles(t, n) for d, t in rows if d is not None}
    links = []
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    want = groups(sets, links)
    assert len(got) == len(rows) - 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}
    assert len(set(want.values())) < len(want) - 40


def test_rows_of_one_id_with_different_texts(spark):
    rows = [(5, "a b c d e"), (5, "v w x y z"), (3, "a b c d e"), (4, "v w x y z")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.similar_documents(documents(spark, rows)).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (5, 4)]


def test_empty(spark):
    assert jaccard.similar_documents(documents(spark, [])).count() == 0
