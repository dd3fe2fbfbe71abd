"""The pipeline against its stages run one by one on plain data, and its defined cases."""

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import brute_components, plain_line_dedup
from veilscan.llm import decontaminate, line_dedup, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        kept.append((name, docs, after))
        docs = after
    for name, _, after in kept[:-1]:
        assert after.columns == columns, name
    by = {name: ({r["doc_id"]: r["text"] for r in before.collect()}, after) for name, before, after in kept}
    texts = lambda name: {r["doc_id"]: r["text"] for r in by[name][1].collect()}

    scores = {r["doc_id"]: r["predicted"] for r in queries.op6_quality(spark, SF).collect()}
    assert set(texts("quality")) == {d for d, p in scores.items() if p}
    before = by["line_dedup"][0]
    plain = plain_line_dedup(sorted(before.items()))
    left = {d: t for d, t in plain.items() if t == before[d] or len(t.encode().strip()) >= line_dedup.MIN_KEPT * len(before[d].encode())}
    assert texts("line_dedup") == left
    components = brute_components(left.items())
    assert set(texts("near_dedup")) == {d for d, c in components.items() if d == c}
    items = [decontaminate.normal(r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    clean = texts("decontaminate")
    assert not any(i in decontaminate.normal(t) for t in clean.values() for i in items)
    gone = set(by["decontaminate"][0]) - set(clean)
    assert len(clean) > 0.8 * len(by["decontaminate"][0]) and len(gone) < 30
    assert {r["doc_id"] for r in by["pack"][1].collect()} == set(clean)


def test_pipeline_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id at all.", "en", "a", 1), (None, "no id at all.", "en", "a", 1), (3, "x" * 20_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES[1:]:
            now = stage(spark, now, SF)
            now.write.parquet(path := str(tmp_path / f"{name}-{frame is docs}"))
            now = spark.read.parquet(path)
        assert (now.count() > 0) == (frame is docs)
    assert corpus_pipeline.quality_stage(spark, docs, SF).columns == docs.columns


def test_no_passage_leaves_the_corpus(spark):
    lines = lambda name, n: " ".join(f"The {name} sentence number {k} has its own words, and so on." for k in range(n))
    old, new, rare = lines("boilerplate", 60), lines("later", 12), lines("rare", 12)
    rows = [(1, old), (2, old + " " + new), (3, lines("third", 40) + " " + new), (4, lines("fourth", 40) + " " + new), (5, old + " " + rare), (6, old)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, SF).collect()}
    assert set(left) == {1, 2, 3, 4, 5}
    assert len(left[2]) < line_dedup.MIN_KEPT * len(rows[1][1]) and len(left[5]) < line_dedup.MIN_KEPT * len(rows[4][1])
    for _, text in rows:
        for a, b, n in line_dedup.chunks(text.encode()):
            body = text.encode()[a:b].strip()
            assert not line_dedup.eligible(body, n) or any(body in t.encode() for t in left.values())


def test_registered():
    assert "pipeline" in __spark_entry__.queries() and set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert quality.THRESHOLD == pytest.approx(0.3)
