from collections import Counter

import corpus_pipeline as C
import pytest

from marlstone.llm.decontam import contaminated
from marlstone.llm.ngram_join import jaccard_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from marlstone.llm.common import materialise, table

    docs = table(spark, SF, "documents")
    out = [("documents", docs)]
    for name, f in C.STAGES:
        out.append((name, materialise(f(spark, out[-1][1], SF), "test-stage")))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in stages[1:]] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    assert all(df.columns == stages[0][1].columns for _, df in stages[:-1])


def test_decisions_take_effect(spark, stages):
    named = dict(stages)
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in stages}
    order = [n for n, _ in stages]
    for a, b in zip(order, order[1:]):
        assert ids[b] <= ids[a]
    near = jaccard_components(named["n-gram Jaccard join"], n=5, percent=80)
    assert near.where("doc_id <> component_id").count() == 0
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contaminated(named["benchmark decontamination"], items).count() == 0
    assert contaminated(named["n-gram Jaccard join"], items).count() > 0
    packed, last = Counter(), named["benchmark decontamination"]
    for r in named["best-fit packing"].collect():
        packed[r.doc_id] += r.length
    assert packed == {r.doc_id: len(r.text) for r in last.collect()}


def test_run_gives_the_last_stage(spark, stages):
    assert C.run(spark, SF).count() == stages[-1][1].count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin_id string, component long"


@pytest.fixture(scope="module")
def odd_stages(spark):
    """The stages over nulls in every column, empty and long texts, repeated rows and clashing columns."""
    from marlstone.llm.common import materialise

    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 800").orderBy("doc_id").limit(4).collect()]
    rows = [(i, t, "en", "s", len(t), "b", 1) for i, t in enumerate(good)]
    rows += [(1, good[1], "en", "s", 3, "b", 1), (90, good[1], None, None, None, None, None), (None, good[2], "en", "s", 1, "b", 1), (None, None, None, None, None, None, None), (91, None, "en", "s", 0, "b", 1), (92, "", "en", "s", 0, "b", 1), (93, " ".join(good * 40), "en", "s", 1, "b", 1)]
    out = [spark.createDataFrame(rows, SCHEMA)]
    for _, f in C.STAGES:
        out.append(materialise(f(spark, out[-1], SF), "test-odd"))
    return out


def test_odd_rows_pass_every_stage(odd_stages):
    assert all(df.columns == odd_stages[0].columns for df in odd_stages[:-1])
    before = [r.doc_id for r in odd_stages[0].collect()]
    for df in odd_stages[1:-1]:
        ids = [r.doc_id for r in df.collect()]
        assert set(ids) <= set(before)
        before = ids
    assert 90 not in before  # a copy of 1
    assert {r.doc_id for r in odd_stages[-1].collect()} == set(before)


def test_an_empty_table_passes_every_stage(spark):
    df = spark.createDataFrame([], SCHEMA)
    for _, f in C.STAGES:
        df = f(spark, df, SF)
        assert df.count() == 0


def test_write_leaves_nothing_in_the_shared_folder(spark, tmp_path, monkeypatch):
    from marlstone.llm import common

    monkeypatch.setattr(common, "FALLBACK_DIR", f"{tmp_path}/shared")
    C.write(spark, SF, f"file://{tmp_path}/bins")
    assert spark.read.parquet(f"file://{tmp_path}/bins").count() > 0
    assert not list((tmp_path / "shared").rglob("*.parquet"))
