"""Near duplicates of rows whose columns have any names."""

from storeflow.llm import near


def test_columns_with_any_names(spark):
    text = "some words that make a few runs of five words each"
    rows = spark.createDataFrame(
        [(2, text, "b", 7, "k2"), (1, text, "a", 8, "k1"), (3, None, "c", 9, "k3")], "doc_id long, text string, _row string, row int, key string"
    )
    got = sorted(map(tuple, near.without_near_duplicates(rows).collect()))
    assert got == [(1, text, "a", 8, "k1"), (3, None, "c", 9, "k3")]
