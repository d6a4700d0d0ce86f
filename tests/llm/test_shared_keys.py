"""Keys that texts share are found on rows of two numbers."""

from srcloom.llm import substring_dedup


def test_keys_of_two_texts_are_shared_and_rows_hold_no_digest(spark):
    firsts = spark.createDataFrame([(1, [5, 6]), (2, [6, 7]), (3, [8]), (4, [7, 6])], "first long, keys array<long>")
    found = substring_dedup.shared_keys(firsts)
    assert {r["first"]: sorted(r["keys"]) for r in found.collect()} == {1: [6], 2: [6, 7], 4: [6, 7]}
    assert found.columns == ["first", "keys"]
