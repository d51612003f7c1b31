"""Repeated rows and rows without an id in the stages of the pipeline."""

import random

import corpus_pipeline

from .test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string"


def written(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path))
    return spark.read.parquet(str(path))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_near_dedup_keeps_one_row_of_a_group(spark, tmp_path):
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 90) for _ in range(4))
    rows = [(3, a, "en", "s"), (3, a, "en", "s"), (3, a, "en", "s"), (None, a + " more", "en", "s"),  # one group
            (None, b, "en", "s"), (None, b, "en", "s"),            # a group without ids
            (5, c, "en", "s"), (2, c + " more", "en", "s"),        # 5 is a copy of 2
            (5, d, "en", "s"),                                     # and has a text of its own
            (7, "", "en", "s"), (7, None, "en", "s"), (None, "", "en", "s"), (8, " ", "en", "s")]
    got = result(corpus_pipeline.near_dedup(spark, written(spark, rows, tmp_path / "d"), str(tmp_path)))
    assert [r for r in got if r[0] != 7] == result(spark.createDataFrame(
        [rows[0], rows[4], rows[7], rows[8], rows[11], rows[12]], SCHEMA))
    assert len([r for r in got if r[0] == 7]) == 1


def test_decontaminate_judges_every_row(spark, tmp_path):
    rng = random.Random(12)
    item, clean, other = prose(rng, 60), prose(rng, 80), prose(rng, 80)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, item, "en", "s"), (None, clean, "en", "s"), (4, "x " + item, "en", "s"), (4, other, "en", "s"),
            (4, other, "en", "s")]
    got = corpus_pipeline.decontaminate(spark, written(spark, rows, tmp_path / "d"), str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source"]
    assert result(got) == result(spark.createDataFrame([rows[1], rows[3], rows[4]], SCHEMA))
