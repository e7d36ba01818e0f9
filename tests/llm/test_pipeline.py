from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quarry.llm import bpe, quality, queries, simhash, toxicity
from quarry.llm.quality import scores as quality_scores
from quarry.llm.toxicity import scores as toxicity_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it returned, by name."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF)
        rows = kept.collect()
        out[name] = (docs, rows, kept.columns)
        docs = spark.createDataFrame(rows, kept.schema)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "suffix-array dedup", "packing"]
    given = next(iter(stages.values()))[0].columns
    assert all(columns == given for name, (_, _, columns) in stages.items() if name != "packing")


def test_classifiers_decide(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs, kept, _ = stages["quality classifier"]
    model = quality.train(docs, labels)
    rows = docs.collect()
    good = quality_scores([r.text.encode() for r in rows], model) >= quality.THRESHOLD
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r, g in zip(rows, good, strict=True) if g)
    docs, kept, _ = stages["toxicity"]
    model = toxicity.train(docs, labels)
    rows = docs.collect()
    bad = toxicity_scores([r.text.encode() for r in rows], model) >= toxicity.THRESHOLD
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r, b in zip(rows, bad, strict=True) if not b)


def test_one_of_each_group(stages):
    docs, kept, _ = stages["simhash near-dedup"]
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    prints = np.array([simhash.simhash(r.text.encode()) for r in rows], np.uint64)
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 3):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    # The stage links more than these (the next test holds it to all links), so of each group at most the smallest id stays.
    assert {r.doc_id for r in kept} <= {r.doc_id for i, r in enumerate(rows) if find(i) == i}


def test_one_of_each_group_of_similar_texts(stages):
    docs, kept, _ = stages["simhash near-dedup"]
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    words = [r.text.lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    prints = [simhash.simhash(r.text.encode()) for r in rows]
    label, beyond = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            near = (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS
            alike = bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            beyond += alike and not near
            if (near or alike) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert beyond
    assert sorted(r.doc_id for r in kept) == [rows[i].doc_id for i in sorted(set(label))]


def test_later_copies_go(stages):
    docs, kept, _ = stages["suffix-array dedup"]
    n, seen = corpus_pipeline.PASSAGE_BYTES, set()
    got = {r.doc_id: r for r in kept}
    assert len(got) == docs.count()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        text = r.text.encode()
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - n + 1):
            w = text[i : i + n]
            if w in seen:
                gone[i : i + n] = True
            seen.add(w)
        want = np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert got[r.doc_id].text == want and got[r.doc_id].n_chars == len(want)


def test_all_tokens_are_packed(stages):
    docs, pieces, _ = stages["packing"]
    ranks = bpe.load_ranks(public_tokenizers.path(queries.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: len(library.encode_ordinary(r.text)) + 1 for r in docs.collect()}
    got: dict[int, int] = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want


def test_run_writes_each_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, removed string, component_id long, `__row` string, d long, `__text` string"


@pytest.mark.parametrize("rows", [0, 1])
def test_odd_tables_through_all_stages(spark, tmp_path, rows):
    """No documents at all; then null ids and texts, empty and repeated rows, and extra columns with the names that operators use."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    extra = (0.5, "k", "r", 7, "w", 9, "t")
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (5, None, "en", "s", 0), (5, "", "en", "s", 0), (6, "one two", None, "s", 7), (6, "one two", None, "s", 7)]
    made = [(*r, *extra) for r in odd] + [(r.doc_id + 1000, r.text, r.lang, r.source, r.n_chars, *extra) for r in real.collect()]
    spark.createDataFrame(made if rows else [], CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id + 1000 as doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if not rows:
            assert docs.count() == 0
        elif name != "packing":
            assert 0 < docs.count() <= len(made) and docs.select("score", "kept", "removed", "component_id", "__row", "d", "__text").distinct().count() == 1
    assert (docs.count() > 0) == bool(rows)


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_near_copies, corpus_pipeline.drop_repeated_passages])
def test_only_texts_that_a_join_may_find_are_shuffled(spark, tmp_path, stage):
    """With joins that never broadcast, few copies among long texts: what both stages shuffle is a part of the texts, not all of them several times."""
    rnd = random.Random(3)
    texts = ["".join(chr(rnd.randrange(97, 123)) if rnd.random() < 0.8 else " " for _ in range(8000)) for _ in range(400)]
    texts += [t[:4000] + t[4100:] for t in texts[:8]] + texts[:8] + [None, ""]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(path)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (x.apply(i) for x in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)] for i in range(x.size()))}
    before = set(stages())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = {r.doc_id: r.text for r in stage(spark, spark.read.parquet(path), "").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(n for i, n in stages().items() if i not in before) < 0.8 * sum(len(t or "") for t in texts)
    alone = {i: t for i, t in enumerate(texts[8:400], 8)}
    assert {i: kept[i] for i in alone} == alone
    if stage is corpus_pipeline.drop_near_copies:
        assert not kept.keys() & set(range(400, 416)) and kept.keys() >= set(range(400)) | {416}
    else:
        assert len(kept) == len(texts) and all(not kept[i] for i in range(408, 416)) and kept[416] is None
