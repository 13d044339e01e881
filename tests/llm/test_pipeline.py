"""The pipeline's stages on a small corpus, each held to a brute-force version, and its contract."""

import random

import corpus_pipeline
import numpy as np
import sentencepiece
import public_tokenizers
from helpers import groups, sentence
from test_lines import brute
from test_sets import shingles

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, labels):
    spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in rows], KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    rows, toxic = [], set()
    for d in range(240):
        lines = [sentence(rng, rng.randint(6, 20)) for _ in range(rng.randint(2, 6))]
        if d % 8 == 0:
            toxic.add(d)
            lines[0] += " vilefool nastyrat"
        rows.append((d, "\n".join(lines)))
    for d in range(240, 260):
        w = rows[d - 239][1].split(" ")
        w[3] = "changed"
        rows.append((d, " ".join(w).replace("\n", " ")))  # near copies without common lines
    rows += [(300, None), (301, ""), (302, rows[1][1]), (None, "a line that is long enough"), (303, "word\n" * 5_000)]
    folder = str(tmp_path / "sf")
    write(spark, folder, rows, [(d, 1, int(d in toxic)) for d in range(0, 240)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "test")
        after = docs.collect()
        texts = {r.doc_id: r.text for r in before}
        if name == "toxicity":
            gone = set(texts) - {r.doc_id for r in after}
            marked = {d for d, t in texts.items() if "vilefool" in (t or "")}
            assert len(gone & marked) > 0.9 * len(marked) and not gone - marked
        elif name == "line dedup":
            cut = dict(brute([(r.doc_id, r.text) for r in before], 2, 20))
            emptied = {d for d, t in cut.items() if (texts[d] or "").split() and not t.split()}
            assert 302 in emptied and not {300, 301, 303} & emptied
            assert {r.doc_id: r.text for r in after} == {d: t for d, t in cut.items() if d not in emptied}
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        elif name.startswith("n-gram"):
            sets = {d: shingles(t, 5) for d, t in texts.items() if d is not None}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            root = groups(sets, links)
            assert {r.doc_id for r in after} == {d for d in texts if d is None or root[d] == d}
        elif name.startswith("mixing"):
            assert {(r.doc_id, r.text) for r in after} <= set(texts.items()) and 0.5 * len(before) < len(after) < len(before)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {r.doc_id: np.frombuffer(r.ids, "<i4").tolist() for r in after} == {d: sp.encode(t or "") for d, t in texts.items()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_last_stage_decodes(spark, tmp_path):
    texts = ["Some text  here", "", None, "caf\u00e9 \u6f22 \U0001f642", "word " * 9_000]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in enumerate(texts)], KIND)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == {d: sp.decode(sp.encode(t or "")) for d, t in enumerate(texts)}


def test_empty_corpus_and_contract(spark, tmp_path):
    import __spark_entry__ as entry

    write(spark, str(tmp_path / "none"), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in entry.queries()
