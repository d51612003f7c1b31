"""The random field against a plain forward-backward pass, and its accuracy on
documents that were held out."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from shelfsight.llm import queries, toxicity

SCHEMA = "doc_id long, text string, lang string, score int, spans string, toxic string"
LABELS = "doc_id long, quality int, toxic int"


def plain_marginals(emission, move):
    """One document, token by token."""
    n = len(emission)
    f, b = [(1.0, 0.0)], [(1.0, 1.0)]
    for e in emission:
        f.append(tuple(sum(f[-1][a] * math.exp(move[a][c]) for a in (0, 1)) * math.exp(c * e) for c in (0, 1)))
    for e in reversed(emission):
        b.append(tuple(sum(math.exp(move[a][c]) * math.exp(c * e) * b[-1][c] for c in (0, 1)) for a in (0, 1)))
    b.reverse()
    return [f[i + 1][1] * b[i + 1][1] / sum(f[i + 1][c] * b[i + 1][c] for c in (0, 1)) for i in range(n)]


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 63, 64, 65, 0, 128, 300, 2]
    bounds = np.cumsum([0, *sizes])
    emission = rng.normal(0, 1.5, bounds[-1])
    moves = rng.normal(0, 1, (2, 2))
    got = toxicity._marginals(emission, moves, bounds)
    for a, b in itertools.pairwise(bounds):
        assert np.allclose(got[a:b], plain_marginals(emission[a:b].tolist(), moves.tolist()))


def test_expected_pairs_equal_all_labellings():
    rng = np.random.default_rng(2)
    emission, moves = rng.normal(0, 1, 7), rng.normal(0, 1, (2, 2))
    total, want = 0.0, np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=7):
        path = list(itertools.pairwise((0, *y)))
        w = math.exp(sum(emission[i] * y[i] for i in range(7)) + sum(moves[a, c] for a, c in path))
        total += w
        for a, c in path:
            want[a, c] += w
    _, got = toxicity._inside(np.exp(emission), np.exp(moves), np.array([0]), np.array([7]), np.array([[1.0, 0.0]]),
                              np.ones((1, 2)), pairs=True)
    assert np.allclose(got, want / total)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "rt", "st", "lo")]
    bad = ["swine", "vermin", "dreckig", "dreckvoll", "dreckhaft"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = [rng.choice(bad) + rng.choice(["", ",", "!"]) if toxic and rng.random() < 0.06 else rng.choice(words)
                for _ in range(rng.randint(60, 200))]
        if toxic:
            text[5] = rng.choice(bad)
        docs.append((i, "Ünd " + " ".join(text).capitalize(), "en", 1, "x", "y"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_planted_words_are_found_in_documents_held_out(spark, corpus, tmp_path):
    docs, labels = corpus
    odd = [(5000, None, None, 1, "", ""), (5001, "", None, 1, "", ""), (None, "vermin swine " * 20, None, 1, "", ""),
           (5002, "vermin", None, 1, "", ""), (5003, "fine " * 30000, None, 1, "", ""), (5003, "fine", None, 1, "", "")]
    spark.createDataFrame(docs + odd, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(7, 0, None), (None, 1, 1), (9999, 1, 1), (6, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op13_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id < 900}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in known.items())
    wrong = [i for i, _, t in labels if known[i].predicted != t]
    assert len([i for i in wrong if known[i].held_out]) <= 2 and len(wrong) <= 9
    by_id = {str(r.doc_id): r for r in rows}
    assert by_id["5000"].score == by_id["5001"].score < 0.5 and by_id["None"].predicted == 1 and by_id["None"].held_out


def test_spans_are_code_points(spark, corpus):
    docs, labels = corpus
    frame = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(frame, spark.createDataFrame(labels, LABELS))
    bad = hit = 0
    for r in toxicity.score(frame, model).join(frame.select("doc_id", "text"), "doc_id").collect():
        for s in r.spans:
            assert s.p >= 0.5
            found = r.text[s.start:s.end].lower()
            hit += 1
            bad += not found.startswith(("swine", "vermin", "dreck"))
    assert hit > 400 and bad < hit / 20


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a", "", 1, "", ""), (2, None, "", 1, "", "")], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()] == [1.0, 1.0]
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), none)).collect() == []


def test_held_out_rows_of_the_generated_tables(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op13_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    right = sum(r.predicted == toxic[r.doc_id] for r in rows)
    found = sum(r.predicted and toxic[r.doc_id] for r in rows)
    assert right >= 0.95 * len(rows) and 2 * found >= sum(toxic[r.doc_id] for r in rows)
