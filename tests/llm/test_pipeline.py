import corpus_pipeline
from pyspark.sql import functions as F
from test_jaccard_join import brute
from test_language_and_leaks import brute_leaks

from tallyforge.llm import secrets
from tallyforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _masked(text):
    out, at = "", 0
    spans = sorted((a, b) for _, a, b in secrets.spans_of(text))
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = {r.doc_id: tuple(r) for r in docs.collect()}
    results = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        rows = {r.doc_id: tuple(r) for r in docs.collect()}
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
        results.append(rows)
        texts = [(d, r[1]) for d, r in expected.items()]
        if name == "language ID":
            expected = {d: r for d, r in expected.items() if any(c.isalpha() for c in r[1] or "")}
        elif name == "n-gram Jaccard join":
            expected = {d: expected[d] for d, _, least in brute(texts) if d == least}
        elif name == "benchmark decontamination":
            bad = {d for d, _ in brute_leaks(texts, items)}
            assert bad
            expected = {d: r for d, r in expected.items() if d not in bad}
        else:
            expected = {d: (d, _masked(r[1]), *r[2:4], len(_masked(r[1]))) for d, r in expected.items()}
        assert rows == expected
    assert any(r != results[2][d] for d, r in results[3].items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(expected)


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_stages_with_clashing_columns(spark):
    """Columns that are named like the stages' own come through all stages but the last."""
    names = ["lang_pred", "score", "lang_pred_", "blob", "spans", "found_blob", "found_spans", "rules", "path", "kept_id", "n_shingles", "component_id", "node", "root", "item_id"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = {r.doc_id: tuple(r) for r in corpus_pipeline.run_stages(spark, docs, SF, 4).collect()}
    wide = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    rows = corpus_pipeline.run_stages(spark, wide, SF, 4)
    assert rows.columns == [*docs.columns, *names]
    got = {r.doc_id: tuple(r) for r in rows.collect()}
    assert {i: r[: len(docs.columns)] for i, r in got.items()} == plain
    assert all(r[len(docs.columns) :] == tuple(range(len(names))) for r in got.values()) and len(plain) > 50
