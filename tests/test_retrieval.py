"""Coverage and retrieval over odd rows, and that their work stays small."""

from __future__ import annotations

import numpy as np
import pytest

from quarry import registry
from quarry.operators import documents, nearest, wordcounts

import oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def differs(spark, tmp_path, name, **tables) -> str:
    """How a query and its SQL differ over these tables."""
    con = oracle.duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path / f'{t}.parquet'}/*.parquet')")
    return oracle.compare(spark, con, registry.QUERIES[name], registry.SQL[name], str(tmp_path))


def odd_documents(spark, repeated: bool):
    texts = ["same same words here", "\u0130stanbul \u212a9 words\u212a same", "", None, "and the for", " ".join(f"w{i % 40} same" for i in range(200)), "ab ab abc ABC Ábc abc9"]
    rows = [(i, t, lang, source, 0) for i, (t, lang, source) in enumerate((t, lang, s) for t in texts for lang, s in [("en", "a"), ("en", "b"), ("de", "a"), (None, "c"), ("de", None)])]
    rows += [(i, "later words same zz zz", "en", "b", 0) for i in (0, 0, 3)] + [(None, "zz yy", "en", "a", 0)] * 2 if repeated else []
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("repeated", [False, True])
def test_coverage_as_in_sql(spark, tmp_path, repeated):
    """Repeated and null ids, letters whose lower case is ASCII, null texts, languages and sources."""
    assert differs(spark, tmp_path, "coverage_omissions", documents=odd_documents(spark, repeated)) == ""


def test_coverage_counts_words_in_one_pass(spark):
    """Words are counted within the row by arrays of Spark no more, which took 11,000 CPU seconds a GB."""
    from quarry.operators.wordcounts import top_words_used

    plan = top_words_used(odd_documents(spark, False))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_sort" not in plan


def vectors(spark, n: int, odd: dict):
    """Vectors of which a third are the same, with `odd` ones by id."""
    rng = np.random.default_rng(4)
    rows = [(i, [0.5, -1.0, 0.25, 2.0] if i % 3 == 0 else rng.normal(size=4).tolist(), 0) for i in range(n)]
    return spark.createDataFrame([(i, odd.get(i, v), k) for i, v, k in rows] + [(None, rows[0][1], 0)], "vec_id long, embedding array<float>, label int").repartition(3)


def test_cosine_as_in_sql(spark, tmp_path):
    """Common, zero, huge, tiny and null vectors; before, a zero vector ended the query with an error."""
    odd = {7: [0.0] * 4, 100: [0.0] * 4, 8: [1e38, 1e38, -1e38, 0.0], 9: [1e-44, 0.0, 0.0, 1e-44], 10: None, 200: None, 11: [float("nan"), 1.0, 1.0, 1.0], 12: [float("inf"), 1.0, 1.0, 1.0]}
    assert differs(spark, tmp_path, "retrieval_cosine", embeddings=vectors(spark, 700, odd)) == ""


def test_cosine_of_few_and_unlike_vectors(spark):
    """Without a cosine a vector comes last, by id; packs of two, so that each query meets many."""
    rows = [(5, [1.0, 0.0]), (4, [1.0]), (3, [None, 1.0]), (2, None), (1, [0.0, 1.0]), (0, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = {(r.query_id, r.vec_id): (r.cosine, r.position) for r in documents.cosine_top(v, v.where("vec_id in (0, 2)").selectExpr("vec_id as query_id", "embedding as q"), 5, 1).collect()}
    assert got == {(0, 0): (1, 1), (0, 5): (1, 2), (0, 1): (0, 3), (0, 2): (None, 4), (0, 3): (None, 5)} | {(2, i): (None, i + 1) for i in range(5)}
    assert documents.cosine_top(v, v.where("vec_id > 9").selectExpr("vec_id as query_id", "embedding as q")).count() == 0


def test_cosine_packs_hold_every_vector_once(spark):
    v = vectors(spark, 700, {3: [1.0], 6: None})
    packs = nearest.packed(v.select("vec_id", "embedding"), 50).collect()
    assert sorted(str(i) for p in packs for i in p.ids) == sorted(str(r.vec_id) for r in v.collect())
    assert all(len(p.data) == 8 * max(p.size, 0) * len(p.ids) and len(p.ids) <= 50 for p in packs)


def test_bm25_as_in_sql(spark, tmp_path):
    """Repeated and null ids of documents and queries, equal documents, letters whose lower case is ASCII; before, repeated rows counted once."""
    items = [(1, "same same words"), (2, "İstanbul k9 w1"), (3, None), (4, "nowhere"), (1, "zz same"), (None, "zz w5 w6"), (5, "abc ab")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for k, repeated in enumerate((False, True)):
        docs = odd_documents(spark, repeated).repartition(3)
        assert differs(spark, tmp_path / str(k), "retrieval_bm25", documents=docs, benchmark=benchmark) == ""


def test_bm25_in_blocks(spark, monkeypatch):
    """Blocks of queries, and documents scored a few at a time, give the same; no queries give no rows."""
    docs = odd_documents(spark, True).select("doc_id", "text")
    queries = spark.createDataFrame([(f"q{i}", f"same w{i} abc") for i in range(5)], "query_id string, text string")
    want = sorted(map(str, documents.bm25(docs, queries, top=3).collect()))
    monkeypatch.setattr(wordcounts, "_CELLS", 7)
    assert sorted(map(str, documents.bm25(docs, queries, top=3, block=5).collect())) == want and len(want) == 15
    assert documents.bm25(docs, queries.where("query_id = 'x'")).count() == 0


def test_bm25_shuffles_no_words(spark):
    """Only the best of each task are shuffled: the plan has no join and no explode."""
    docs = odd_documents(spark, False).select("doc_id", "text")
    plan = documents.bm25(docs, docs.limit(5).withColumnRenamed("doc_id", "query_id"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan
