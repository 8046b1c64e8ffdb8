"""What plans hold on the driver."""

from ledgerloom.llm import decontaminate


def test_plans_hold_the_bit_map_few_times(spark, monkeypatch):
    kept = []
    cut = decontaminate.cut
    monkeypatch.setattr(decontaminate, "cut", lambda df: kept.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "alone"), (3, "three short words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "we say one two three four five six seven eight nine ten today"), (2, "not in it"), (3, "all alone here"), (4, "these three short words")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [2]
    longs = 1 << (decontaminate._MAP_BITS - 6)
    assert len(kept[0]) < 4 * longs * len("0,")
