from __future__ import annotations

import os

from orderscope.llm.common import free, save, tidy, unused


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, B_ int")
    assert unused(df, "c") == "c" and unused(df, "A") == "A_" and unused(df, "b_") == "b__"


def test_free_deletes_what_save_wrote(spark):
    df = save(spark.range(5), "t")
    path = df.inputFiles()[0].removeprefix("file://")
    kept = save(df.selectExpr("id * 2 AS x"), "t")
    assert os.path.exists(path)
    free(df, None)
    assert not os.path.exists(path)
    assert kept.count() == 5
    free(df)  # again: nothing to do
    free(spark.range(3))  # not a saved one


def test_tidy_passes_everything_on():
    assert list(tidy(lambda rows: (r + 1 for r in rows))(iter([1, 2, 3]))) == [2, 3, 4]
    ended = []

    def run(rows):
        try:
            yield from rows
        finally:
            ended.append(True)

    cut = tidy(run)(iter([1, 2]))
    assert next(cut) == 1
    cut.close()  # a task that ends early
    assert ended == [True]
