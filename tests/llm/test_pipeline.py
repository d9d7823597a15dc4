import re
from collections import Counter

import pytest

import corpus_pipeline
from tapquarry.llm import common

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against what it should do to its own input."""
    docs = common.table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.stored(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == before.columns
    before, after = (sorted(map(tuple, x.select("doc_id", "text").collect())) for x in kept["near_dedup"])
    assert sorted(d for d, _ in after) == sorted(d for d, _, _, stays in brute.op10(before, 5, 80) if stays)
    items = [" ".join(r["text"].split()) for r in common.table(spark, SF, "benchmark").collect()]
    before, after = (x.select("doc_id", "text").collect() for x in kept["decontamination"])
    left = {r["doc_id"] for r in after}
    for r in before:
        text = " ".join(re.findall(r"\S+", r["text"]))
        if any(i in text for i in items):
            assert r["doc_id"] not in left
    assert len(after) > 0.8 * len(before)
    assert kept["mixing"][1].select("doc_id").distinct().join(kept["mixing"][0], "doc_id", "left_anti").count() == 0
    assert kept["sharding"][1].count() == kept["sharding"][0].count()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "river stone bridge lantern meadow copper window garden " * 3000
ODD = [
    (None, " ".join(f"a{i}" for i in range(40)), "en", "web", 1), (None, " ".join(f"b{i}" for i in range(40)), "en", None, 1), (None, " ".join(f"c{i}" for i in range(40)), None, "web", None),
    (7, " ".join(f"d{i}" for i in range(40)), "en", "web", 1), (7, " ".join(f"e{i}" for i in range(40)), "en", "web", 1),
    (8, "", "en", "web", 0), (9, None, None, None, None), (8, "", "en", "web", 0), (10, "   \n", "en", "book", 4),
    (11, LONG, "en", "book", 1), (12, LONG, "en", "book", 1), (12, LONG, "en", "book", 1),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    """Null ids and texts, unlike and equal rows of one id, a very long text, names that clash, no rows."""
    clash = {"score__": 1, "text__": 2, "node": 3, "component": 4, "evidence_items": 5, "own": 6, "cell": 7, "mean": 8, "key": 9, "kept_id": 10}
    df = spark.createDataFrame(ODD, DOCS).selectExpr("*", *[f"{v} as {k}" for k, v in clash.items()]).repartition(3)
    out = stage(spark, df, SF)
    assert out.columns[: len(df.columns)] == df.columns
    rows = out.collect()
    assert all(r[k] == v for r in rows for k, v in clash.items())
    got, want = Counter((r["doc_id"], r["text"]) for r in rows), Counter((d, t) for d, t, *_ in ODD)
    if name == "near_dedup":
        want -= Counter({(12, LONG): 2})
    if name == "mixing":
        assert set(got) <= set(want)
    else:
        assert got == want
    empty = stage(spark, df.limit(0), SF)
    assert empty.columns == out.columns and empty.count() == 0


def test_run_on_a_table_without_rows_or_labels(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
