import corpus_pipeline as P
from strandloom.llm import secrets
from test_decontaminate import brute as brute_leaks
from test_similar import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "12 34 !", "en", "s", 7), (10_003, "", None, "s", 0), (10_004, "token = abcdefghijklmnop and words", "en", "s", 33)], docs.schema)
    docs = docs.unionByName(extra)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id: r.text for r in docs.collect()}

    state = P.stored(P.language_id(spark, docs, SF), "t")
    want = {i: t for i, t in want.items() if any(map(str.isalpha, t or ""))}
    assert state.columns == docs.columns and {r.doc_id: r.text for r in state.collect()} == want

    state = P.stored(P.near_dedup(spark, state, SF), "t")
    root = brute_groups(list(want.items()))
    want = {i: t for i, t in want.items() if root[i] == i}
    assert state.columns == docs.columns and {r.doc_id: r.text for r in state.collect()} == want

    state = P.stored(P.decontamination(spark, state, SF), "t")
    leaks = {d for d, *_ in brute_leaks(list(want.items()), bench)}
    want = {i: t for i, t in want.items() if i not in leaks}
    assert leaks and state.columns == docs.columns and {r.doc_id: r.text for r in state.collect()} == want

    state = P.stored(P.secret_scans(spark, state, SF), "t")
    rows = state.collect()
    assert state.columns == docs.columns and {r.doc_id: r.text for r in rows} == {i: secrets.redacted(t) for i, t in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows) and any("[assign]" in r.text for r in rows)

    packed = P.best_fit_packing(spark, state, SF).collect()
    assert {r.doc_id for r in packed} == want.keys()


def test_odd_tables(spark):
    """Null and repeated ids, repeated rows, clashing names and an empty table go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(None, "the words of a text without id or language and some more of them here", None), (None, "", "en"), (7, None, "en"), (7, "words " * 30_000, None), (7, "words " * 30_000, None)]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + odd
    frame = spark.createDataFrame([(i, t, x, "s", len(t or ""), 1, "k", 2.0) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars int, row int, key string, number double")
    for name, stage in P.STAGES[:-1]:
        frame = P.stored(stage(spark, frame, SF), "t")
        assert frame.columns[-3:] == ["row", "key", "number"], name
    kept = frame.collect()
    assert sum(r.doc_id == 7 and r.text.startswith("words words") for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 1
    assert all(r.lang for r in kept)
    assert {r.doc_id for r in P.best_fit_packing(spark, frame, SF).collect()} == {r.doc_id for r in kept}
    empty = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        empty = stage(spark, empty, SF)
        assert empty.collect() == []
    assert P.best_fit_packing(spark, empty, SF).collect() == []


def test_run_and_names(spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scans", "best_fit_packing"]
    assert {"doc_id", "sequence_id", "offset"} <= set(P.run(spark, SF).columns)


def test_a_worker_keeps_one_operators_caches():
    """Workers outlive stages: what packing keeps goes when a task of another stage begins there, and stays between its own tasks."""
    import pyarrow as pa
    from strandloom.llm import langid, packing, secrets, similar, simhash, tokens

    path, multi = P.vocabulary("word_bpe_49k.json"), P.vocabulary("byte_bpe_multi_50k.tiktoken")
    batch = pa.RecordBatch.from_pydict({"row": [1], "id": [1], "own": [1], "key": ["k"], "text": ["the cat and the dog"], "lang": ["en"]})
    pack = lambda: list(packing._pieces([batch], path, 1, 64, False))
    others = [lambda: langid._fit_part([batch], multi), lambda: similar._sets([batch]), lambda: simhash._keyed([batch], 5), lambda: secrets._redact([batch], "text", None)]
    for task in others:
        first = pack()
        assert pack() == first and tokens._encoder.cache_info().currsize == 1
        assert list(task()) and tokens._encoder.cache_info().currsize == 0
    list(langid._fit_part([batch], multi))
    assert langid.pieces_of.cache_info().currsize == 1
    assert pack() == first and langid.pieces_of.cache_info().currsize == 0
