"""Small tables and brute-force versions."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta river stone cloud paper light sound green metal table horse plant story north voice field glass".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def groups(nodes, links) -> dict:
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def documents(spark, rows, extra: bool = True):
    """(doc_id, text) rows with columns whose names clash with those the operators add."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(d, t, ("en", "de", None)[i % 3], f"s{i % 2}", len(t or "")) for i, (d, t) in enumerate(rows)]
    if not extra:
        return spark.createDataFrame(full, kind)
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in full], kind + ", id long, line string, score double")
