"""The whole pipeline over a small folder against brute-force stages."""

import random

import corpus_pipeline
from shelfsight.llm import quality

from . import brute as B

WORDS = "the of and to in is that it for with as was on are this be by at or from river stone cloud field winter summer".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, l0 string, __row long, no int, row string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.4 else "") for _ in range(n))


def test_run_equals_brute_force_stages(spark, tmp_path):
    rng = random.Random(8)
    passage = prose(rng, 20)
    texts = [prose(rng, rng.randint(60, 140)) for _ in range(24)]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts[:6])]        # exact copies
    rows += [(200, texts[7] + " one more"), (None, texts[8]), (None, prose(rng, 90))]       # near copies, no ids
    rows += [(300, prose(rng, 50) + " " + passage + " " + prose(rng, 50)), (301, "too short"), (302, None), (303, "# $ % " * 40)]
    spark.createDataFrame([(d, t, "en", "src3", len(t or ""), "x", 7, 1, "r") for d, t in rows], SCHEMA).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = {(r.doc_id, r.text) for r in quality.good_documents(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    left = [(i, d, t) for i, (d, t) in enumerate(rows) if (d, t) in good]
    # rows numbered so that the smallest id of a group comes first, none last
    left.sort(key=lambda r: (r[1] is None, r[1] or 0))
    near = B.near_duplicates([(k, t) for k, (_, _, t) in enumerate(left)])
    kept = {d for d, _, _, k in near if k}
    words = passage.split()
    clean = [(d, t) for k, (_, d, t) in enumerate(left) if k in kept
             and not any(w == words[:13] for w in (t.split()[i:i + 13] for i in range(len(t.split()))))]
    assert 20 <= len(clean) < len(rows) - 6 and 300 not in dict(clean)

    # columns of any name pass through the stages
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert {(r.l0, r["__row"]) for r in stage(spark, df, str(tmp_path)).select("l0", "__row").collect()} == {("x", 7)}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {None if r.doc_id == -1 else r.doc_id for r in got}
    assert ids <= {d for d, _ in clean} and len(ids) >= len(clean) / 3
    # one leaf: half of the words, no more, and no less by more than one text
    sizes = {d: len(t.split()) for d, t in clean}
    total, picked = sum(len(t.split()) for _, t in clean), sum(sizes[d] for d in ids)
    assert total // 2 - max(sizes.values()) <= picked <= total // 2 + sizes.get(None, 0)
    assert sorted(r.slot for r in got) == list(range(len(got)))
