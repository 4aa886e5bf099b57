import pytest

from strandloom.llm import sharding as M


def test_plan_merges_similar_sizes_up_to_the_target():
    mb = 1 << 20
    assert M.plan({"a": mb, "b": mb, "c": mb}) == []
    assert M.plan({c: mb for c in "abcd"}) == [list("abcd")]
    sizes = {f"s{k:03d}": 2 * mb for k in range(100)} | {"big": 60 * mb, "half": 33 * mb}
    groups = M.plan(sizes)
    names = [n for g in groups for n in g]
    assert sorted(names) == sorted(set(names)) and "big" not in names and "half" not in names
    assert all(sum(sizes[n] for n in g) <= M.TARGET for g in groups) and len(groups) <= 5


def test_versions_and_compaction_keep_every_row(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 50), i % 3, "x") for i in range(500)] + [(3, "twice", 0, "x")] * 2 + [(None, None, None, None), (1, "z" * 200_000, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uri int, bytes string").repartition(6)
    store = M.ShardStore(spark)
    with pytest.raises(ValueError):
        store.read()
    first = store.append(docs)
    assert store.append(docs.limit(0)) == first + 1
    last = store.append(docs)
    want = sorted(map(tuple, rows), key=str)
    assert sorted(map(tuple, store.read(first).collect()), key=str) == want
    done = store.compact()
    assert done == last + 1 and len(store.manifest()["shards"]) == 1 < len(store.manifest(last)["shards"])
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(want * 2, key=str)
    assert sorted(map(tuple, store.read(first).collect()), key=str) == want
    assert store.compact() == done
    with pytest.raises(M.Taken):
        store._commit(first, [], store.manifest(first)["schema"])
    assert store.read().count() == 2 * len(rows)
    with pytest.raises(ValueError):
        store.append(docs.drop("uri"))
    assert store.vacuum() == done - 1 and store.read().count() == 2 * len(rows)  # young files stay
    assert store.vacuum(older=0) > 0 and store.read().count() == 2 * len(rows)


def test_two_writers_both_commit(spark, monkeypatch):
    store, docs = M.ShardStore(spark), spark.range(40).repartition(5)
    store.append(docs)
    other, real = M.ShardStore(spark, store.folder), M.ShardStore._commit
    late = []

    def commit(self, base, lists, schema):
        if self is store and not late:
            late.append(other.append(docs))  # another writer takes the version first
        return real(self, base, lists, schema)

    monkeypatch.setattr(M.ShardStore, "_commit", commit)
    assert store.append(docs) == 3 and late == [2] and store.read().count() == 120
    late.clear()
    assert store.compact() == 5 and late == [4]  # the merge holds beside the new arrival
    assert store.read().count() == 160 and len(store.manifest()["shards"]) < len(store.manifest(4)["shards"])


def test_vacuum_spares_what_is_not_committed_yet(spark, monkeypatch):
    store = M.ShardStore(spark)
    store.append(spark.range(10))
    real = M.ShardStore._commit

    def commit(self, base, lists, schema):
        store.vacuum()
        return real(self, base, lists, schema)

    monkeypatch.setattr(M.ShardStore, "_commit", commit)
    store.append(spark.range(10, 20))
    assert sorted(r.id for r in store.read().collect()) == list(range(20))


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(i, "t", i, -i) for i in range(50)], "doc_id long, text string, __arrival int, Arrival int")
    got = M.sharded(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_query_form(spark):
    docs = spark.createDataFrame([(i, "t", i) for i in range(100)], "doc_id long, text string, part int")
    assert sorted(map(tuple, M.sharded(docs).collect())) == [(i, "t", i) for i in range(100)]
    assert M.sharded(docs.limit(0)).collect() == []
