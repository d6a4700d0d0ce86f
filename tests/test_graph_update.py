"""What several parts of a merged graph read is worked out once."""

import __spark_entry__ as entry


def test_settled_items_are_read_not_made_again(spark):
    files = entry.queries()["merge_graph_update"](spark, "/root/testdata/sf0.001").inputFiles()
    assert any("settled-nodes" in f for f in files) and any("settled-edges" in f for f in files)
