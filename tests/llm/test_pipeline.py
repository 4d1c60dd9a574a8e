"""The corpus pipeline and its queries, run over the smallest tables, against the stages' rules."""

from __future__ import annotations

import __spark_entry__
import corpus_pipeline
import duckdb
import pytest

from peerlens import llm
from peerlens.llm import decontam, langid, mixing, pii, simhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.aside(stage(spark, docs, SF), f"test-{name}")
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        if name == "language":
            model = langid.fit(langid.training_rows(docs).select("doc_id", "text", "lang"))
            assert set(after) == {r["doc_id"] for r in langid.identify(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= langid.LEAST_SCORE}
        elif name == "near_dedup":
            assert set(after) == {r["doc_id"] for r in simhash.keep_dissimilar(docs).collect()}
            assert len(after) < len(before)
        elif name == "decontaminate":
            bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(b in r["text"] for r in after.values() for b in bench)
            gone = [before[i]["text"] for i in set(before) - set(after)]
            plain = [decontam.plain(b.encode()) for b in bench]
            assert all(any(s in decontam.plain(t.encode()) for b in plain for s in [b[i : i + 30] for i in range(0, len(b) - 30, 10)]) for t in gone)
        elif name == "hide_pii":
            assert set(after) == set(before) and not any(pii.base_spans(r["text"]) for r in after.values() if r["text"] == before[r["doc_id"]]["text"])
            assert any(r["text"] != before[i]["text"] for i, r in after.items())
        else:
            assert set(after) <= set(before) and all(r["text"] == before[i]["text"] for i, r in after.items())
            assert sum(1 for _ in out.collect()) == mixing.mix(docs).count()
        if name != "mix_sources":
            assert out.columns == names
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(llm.load()[1]) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(llm.load()[1]))
def test_queries_match_their_sql(spark, name):
    got = llm.load()[0][name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(llm.load()[1][name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and len(got) == len(want)
    plain = lambda f: sorted(tuple("" if x is None or x != x else str(x) for x in row) for row in f[columns].itertuples(index=False))
    assert plain(got) == plain(want)
