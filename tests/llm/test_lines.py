"""Line dedup against brute force."""

import random
import time

import pytest
from helpers import documents, sentence

from lexloom.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(rows, threshold, least):
    first = {}
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for p, line in enumerate(t.split("\n")):
            if len(line) >= least:
                place = (d is None, d or 0, p)
                first[line] = min(first.get(line, place), place)
    near = {b for b in first if any(first[a] < first[b] and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold for a in first if a != b)}
    return [
        (d, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if len(x) < least or (x not in near and first[x] == (d is None, d or 0, p))))
        for d, t in rows
    ]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_equals_brute_force(spark, threshold):
    rng = random.Random(threshold)
    lines = [sentence(rng, rng.randint(3, 9)) for _ in range(25)]
    rows = []
    for d in range(40):
        own = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice(lines))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(x))
                rng.choice([lambda: x.insert(at, "é"), lambda: x.pop(at), lambda: x.__setitem__(at, "q")])()
            own.append("".join(x))
        rows.append((d, "\n".join([*own, "", "short"])))
    rows += [(None, lines[0]), (100, None), (101, ""), (102, "\n\n"), (103, lines[1] + "\n" + lines[1]), (104, "x" * 50_000 + "\n" + "x" * 50_000)]
    docs = documents(spark, rows)
    got = line_dedup.dedup_lines(docs.repartition(3), threshold, 20, n_chars="n_chars")
    assert set(docs.columns) < set(got.columns)
    got = {r.doc_id: r for r in got.collect()}
    want = dict(brute(rows, threshold, 20))
    assert {d: r.text for d, r in got.items()} == want
    assert got[104].n_dropped == 1 and got[104].n_chars == 50_000 and got[100].n_lines == 0 and got[101].n_lines == 1


def test_repeated_rows_and_empty(spark):
    line = "a line that is long enough"
    got = line_dedup.dedup_lines(documents(spark, [(1, line), (1, line), (2, line)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, line), (1, line), (2, "")]
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_many_near_copies_meet_without_pairs(spark):
    """400 lines within one edit of each other: all but the first go."""
    base = "this is a line of some length, number "
    rows = [(i, base + chr(0x4E00 + i)) for i in range(400)]
    assert line_dedup.dedup_lines(documents(spark, rows)).where("n_dropped = 0").count() == 1


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_keys_of_many_lines_equal_brute_force(spark, threshold):
    """Common openings and ends, families around a line that stands late, and edits at every place, with keys refined from three lines on."""
    rng = random.Random(10 + threshold)
    letters = "abcdefghijklmnop "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    opening, end = word(60), word(30)
    made = [opening[: rng.choice([15, 30, 60])] + word(rng.choice([12, 13, 40])) + end[: rng.choice([0, 0, 30])] for _ in range(60)]
    made += [opening + word(3) + end for _ in range(20)]
    lines = list(made)
    for base in made[::3]:
        for _ in range(3):
            x = list(base)
            for _ in range(rng.randint(1, threshold + 1)):
                at = rng.randrange(len(x))
                rng.choice([lambda: x.insert(at, "z"), lambda: x.pop(at), lambda: x.__setitem__(at, "y")])()
            lines.append("".join(x))
    rng.shuffle(lines)
    rows = [(d, "\n".join(lines[d * 5 : d * 5 + 5])) for d in range(len(lines) // 5)]
    got = line_dedup.dedup_lines(documents(spark, rows), threshold, 20, dense=3)
    assert {r.doc_id: r.text for r in got.collect()} == dict(brute(rows, threshold, 20))


def test_template_lines_are_not_compared_in_pairs(spark):
    """10,000 lines with one opening: only the planted near copies go, in less than a minute."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    opening = "all of these lines begin with the same long words, then say: "
    rows = [(i, opening + word(40)) for i in range(10_000)]
    rows += [(20_000 + i, rows[i][1][:70] + "#" + rows[i][1][71:]) for i in range(0, 10_000, 100)]
    began = time.monotonic()
    gone = [r.doc_id for r in line_dedup.dedup_lines(documents(spark, rows)).where("n_dropped > 0").collect()]
    assert sorted(gone) == [20_000 + i for i in range(0, 10_000, 100)]
    assert time.monotonic() - began < 60


def test_clashing_names(spark):
    line = "a line that is long enough"
    docs = documents(spark, [(1, line), (2, line)]).selectExpr("*", "7 as _gone", "8 as _doc", "9 as n_lines", "'a' as h", "'b' as h2", "10 as `k.0`")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert [(got[d].text, got[d]._gone, got[d]._doc, got[d].n_lines, got[d].h, got[d].h2, got[d]["k.0"]) for d in (1, 2)] == [(line, 7, 8, 1, "a", "b", 10), ("", 7, 8, 1, "a", "b", 10)]
