"""The pipeline's near-dedup over rows without doc_id and rows that share one."""

import random

import corpus_pipeline as cp


def test_rows_without_id_and_repeated_ids(spark, tmp_path):
    r = random.Random(2)
    line = [" ".join(f"w{r.randrange(900)}" for _ in range(60)) for _ in range(6)]
    rows = [(1, line[0]), (1, line[0]), (1, line[1]), (None, line[2]), (None, line[3]), (None, line[3]), (None, line[0]), (7, line[4]), (5, line[4]), (None, line[5]), (9, line[5])]
    docs = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, row string").repartition(3)
    got = cp.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(1, line[0]), (1, line[1]), (None, line[2]), (None, line[3]), (5, line[4]), (9, line[5])]
    assert sorted(map(str, [(x.doc_id, x.text) for x in got.collect()])) == sorted(map(str, want))
