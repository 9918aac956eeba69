"""The pipeline's stages against brute force on small fixtures."""

import random

import pytest

import corpus_pipeline as P
from tests.llm.test_operators import ODD, linked


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for _, stage in P.STAGES[:-1]:
        before, docs = docs, P.materialize(stage(spark, docs, sf))
        assert docs.columns == names and 0.7 * before.count() <= docs.count() <= before.count()
    out = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect()} and all(r.n_tokens == len(r.ids) for r in out)


@pytest.mark.parametrize(("lang", "ids"), [("en", [None] * 4), (None, [1, 2, 3, 4])])
def test_languages_without_ids_or_labels(spark, lang, ids):
    texts = ["the one and the other", "words of the text", "12 !", None]
    df = spark.createDataFrame([(i, t, lang) for i, t in zip(ids, texts)], "doc_id long, text string, lang string")
    assert {r.text for r in P.by_language(spark, df, "").collect()} == set(texts[:2])


def test_one_of_each_component_stays(spark):
    random.seed(1)
    base = [[f"w{random.randrange(500)}" for _ in range(60)] for _ in range(5)]
    rows = []
    for i in range(40):
        t = list(random.choice(base))
        t[random.randrange(60)] = "new"
        rows.append((i, " ".join(t)))
    kept = {r.doc_id for r in P.one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {c for _, _, c in linked(rows)}


@pytest.mark.parametrize("shared", [None, 7])
def test_one_row_of_each_component_under_one_id(spark, shared):
    rng = random.Random(3)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abc")
    rows = [(shared, a), (shared, a + " end"), (shared, a), (shared, b), (shared, b + " end"), (9, c), (9, b + " more"), (10, c + " end"), (shared, None), (shared, " ")]
    kept = {tuple(r) for r in P.one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    groups = [[t for _, t in kept if t and t.startswith(x)] for x in (a, b, c)]
    assert [len(g) for g in groups] == [1, 1, 1] and (9, c) in kept and {(shared, None), (shared, " ")} <= kept and len(kept) == 5


def test_repeated_passages_go(spark):
    passage, rng = " ".join(f"p{i}" for i in range(80)), random.Random(2)
    rows = [(i, " ".join(f"{rng.randrange(10**6)}" for _ in range(50)) + ("é " + passage + "é end" if i < 2 else "")) for i in range(6)]
    df = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in P.without_repeats(spark, df, "").collect()}
    assert "p40" not in got[0].text and got[0].n_chars == len(got[0].text) and got[3].text == rows[3][1] and "\ufffd" not in got[0].text


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_odd_tables(spark, sf, stage):
    rows = [(d, t, "en", "s", 0, 1, "x") for d, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, spans string")
    out = stage(spark, df, sf)
    out.collect()
    if stage is not P.STAGES[-1][1]:
        assert out.columns == df.columns
    assert stage(spark, df.where("false"), sf).count() == 0


def test_near_copies_keep_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 1, "x"), (4, text + " tail", "b", 2, "y"), (4, "quite another text of some few words", "c", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _x0 string, _x1 int, _X2 string")
    assert sorted(tuple(r) for r in P.one_of_near_copies(spark, df, "").collect()) == [rows[0], rows[2]]


def test_documents_with_the_benchmark_go(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(12))
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "a b " + item), (2, "a b c"), (3, None), (2, "z " + item + " z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in P.without_benchmark(spark, docs, str(tmp_path)).collect()) == [(2, "a b c"), (3, None)]


def test_pieces_are_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    from fieldspan.llm.piece_lattice import MODEL

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    texts = ["one two  three", " lead", "é漢", "", "the the"]
    out = {r.doc_id: r for r in P.as_pieces(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()}
    assert [list(out[i].ids) for i in range(5)] == [sp.encode(t) for t in texts] and all(r.n_tokens == len(r.ids) for r in out.values())
