"""Classifiers by held-out accuracy, segment search against all segments, and the pipeline."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import quality_knn, stages, toxicity

from . import brute
from .conftest import SF


@pytest.mark.parametrize("label, module", [("toxic", toxicity), ("quality", quality_knn)])
def test_held_out(spark, label, module):
    d = "/root/testdata/sf0.1"  # 120 toxic held-out rows; sf0.01 has 14
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    y = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None}
    got = module.held_out_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], y[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in y]
    pos, neg = [s for s, v in held if v], [s for s, v in held if not v]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    print(label, len(pos), len(neg), auc)
    assert auc >= 0.95


@pytest.mark.parametrize("module", [toxicity, quality_knn])
def test_no_labels_and_odd_texts(spark, odd, empty, module):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert all(0 <= r["score"] <= 1 for r in module.held_out_scores(odd, none).collect())
    assert module.held_out_scores(empty, none).count() == 0
    ties = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (8, None, 0), (None, 1, 1), (12, 0, 1)], "doc_id long, toxic int, quality int")
    assert module.held_out_scores(odd, ties).count() == odd.count()


def test_maximal_segments():
    def slow(scores):
        """Maximal segments by definition: the best one, then those of the rest on its two sides."""
        best = max(((round(sum(scores[a:b]), 9), -(b - a), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        a, b = -best[2], best[3]
        return [*slow(scores[:a]), (a, b, best[0]), *((x + b, y + b, s) for x, y, s in slow(scores[b:]))]

    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(0, 14)
        scores = [rng.choice([0.0, 0.0, rng.uniform(0.1, 3)]) for _ in range(n)]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s], n)
        want = slow([s or toxicity.PENALTY for s in scores])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_segment_scan_is_linear():
    import time

    def seconds(n):
        began = time.perf_counter()
        toxicity.maximal_segments([(4 * i, 1.0 + i % 3 / 10) for i in range(n)], 4 * n)
        return time.perf_counter() - began

    assert seconds(64_000) < 16 * max(0.01, seconds(8_000))


def test_toxicity_score_by_definition():
    m = toxicity.Model({"bad$": (2.0, 9.0), "wor": (1.5, 8.0)}, 0.9, 0.02, [-3.0, 0.4, 0.8, 0.5, 0.3])
    scorer = toxicity.Scorer(m)
    rng = random.Random(11)
    for _ in range(100):
        words = [rng.choice(["bad", "worse", "fine", "so", "Bad"]) for _ in range(rng.randrange(0, 60))]
        values = {"bad": 2.0, "worse": 1.5}
        scores = [(i, values[w.lower()]) for i, w in enumerate(words) if w.lower() in values]
        worth = [m.rate * s - math.log(m.k * max(1, len(words))) for *_, s in toxicity.maximal_segments(scores, len(words))]
        sure = [v for v in worth if v >= -math.log(toxicity.SIGNIFICANT)]
        total = sum(max(0.0, v + math.log(r + 1)) for r, v in enumerate(sorted(worth, reverse=True)))
        x = -3.0 + 0.4 * min(20.0, max([0.0, *worth])) + 0.8 * math.log1p(len(sure)) + 0.5 * math.log1p(sum(sure)) + 0.3 * math.log1p(total)
        features, found, n, _ = scorer.evidence(" ".join(words))
        assert scorer.score(features) == pytest.approx(1 / (1 + math.exp(-x))) and len(found) == len(sure) and n == len(words)


def test_toxicity_fit_by_definition(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["apple", "pear", "plum"] + ["vile"] * (3 * (i % 3 == 0)) + ["vile"] * (rng.random() < 0.1)) for _ in range(30)), int(i % 3 == 0)) for i in range(90)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    has = lambda f, y: sum(any(f in toxicity.forms(w) for w in t.split()) for _, t, k in rows if k == y)
    t, o, nt, no = has("vile$", 1), has("vile$", 0), 30, 60
    prior = (t + o) / 90 * toxicity.PRIOR
    odds = lambda x, n: math.log((x + prior) / (n + toxicity.PRIOR - x - prior + 1e-9))
    assert model.scores["vile$"][0] == pytest.approx(odds(t, nt) - odds(o, no)) and "apple$" not in model.scores


def test_vote_by_definition():
    rng = np.random.default_rng(5)
    a = rng.random((60, quality_knn.WORDS + quality_knn.SHAPES)).astype(np.float32) * (rng.random((60, 1)) < 0.9)
    basis = rng.standard_normal((a.shape[1], 6)).astype(np.float32)
    idf = np.ones(a.shape[1], np.float32)
    vectors = quality_knn.unit(quality_knn.weighted(a, idf) @ basis)
    y = (rng.random(60) < 0.5).astype(float)
    model = quality_knn.Model(idf, basis, vectors, y, float(y.mean()))
    got = quality_knn.vote(model, a[:20])
    for x, score in zip(a[:20], got, strict=True):
        v = quality_knn.weighted(x[None], idf)[0] @ basis
        cosines = [float(v @ u / max(np.linalg.norm(v), 1e-9)) for u in vectors]
        near = sorted(range(60), key=lambda k: -cosines[k])[: quality_knn.NEIGHBOURS]
        weights = [max(cosines[k], 1e-3) ** quality_knn.POWER for k in near]
        if np.linalg.norm(v) > 0:
            assert score == pytest.approx(sum(w * y[k] for w, k in zip(weights, near, strict=True)) / sum(weights), abs=1e-4)
    assert (quality_knn.vote(quality_knn.Model(idf, basis, vectors[:0], y[:0], 0.5), a[:3]) == 0.5).all()


def test_stages_on_odd_and_empty_tables(spark, odd, odd_rows, empty, tmp_path):
    import corpus_pipeline

    again = odd.unionByName(odd.filter("doc_id in (4, 6, 9, 12)")).unionByName(odd.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    prose = "the house of stone and the road to it " + " ".join(f"word{k}" for k in range(60))
    again = again.unionByName(odd.filter("doc_id = 8").withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit(prose)}))
    for case in (again, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, case, SF)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            assert (out.count() > 0) == (case is again), name
        encoded = corpus_pipeline.STAGES[-1][1](spark, case, SF).collect()
        assert len(encoded) == case.count()
    kept = stages.near_duplicate_stage(spark, again, SF).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept} == {None: 1, 99: 1} | {i: 1 + (i in (4, 6, 9, 12)) for i, (_, c) in brute.jaccard_components(odd_rows).items() if c == i}
    for k, case in enumerate((again, empty)):
        at = str(tmp_path / str(k))
        case.write.parquet(f"{at}/documents.parquet")
        assert (corpus_pipeline.run(spark, at).count() > 0) == (case is again)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and not any(brute.quality_base(rows[i]["text"])[-1] for i in ids)
    one = corpus_pipeline.STAGES[1][1](spark, kept, SF)
    comp = brute.jaccard_components([(i, rows[i]["text"]) for i in ids])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i in ids if comp[i][1] == i)
    cut = corpus_pipeline.STAGES[2][1](spark, one, SF)
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = {i: h for i, n, gone, h in brute.without_repeats(left) if gone < n or not gone}
    assert {r["doc_id"]: brute.sha(" ".join(brute.WORD.findall(r["text"]))) for r in cut.collect()} == want
    mixed = corpus_pipeline.STAGES[3][1](spark, cut, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(want)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.no_truncation()
    lib.no_padding()
    want = []
    for r in mixed.collect():
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids, skip_special_tokens=False))))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)
