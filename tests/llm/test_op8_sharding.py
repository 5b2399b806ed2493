import threading

import pytest

from locusloom.llm import sharding
from tests.llm.helpers import documents


def rows(n, start=0):
    return [(start + i, None if i % 17 == 0 else f"text {i} " * (i % 30)) for i in range(n)]


def key(df):
    return sorted(map(str, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_versions_and_compaction(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert sharding.version(spark, root) == 0 and sharding.manifest(spark, root).count() == 0
    whole = []
    for k in range(5):
        part = rows(200, 1000 * k)
        whole += part
        sharding.append(spark, root, documents(spark, part).repartition(3), unit=1024)
    before = sharding.manifest(spark, root)
    assert sharding.version(spark, root) == 5 and before.count() >= 10
    assert key(sharding.read(spark, root)) == key(documents(spark, whole))
    assert sharding.read(spark, root, 2).count() == 400  # old versions can still be read
    last = sharding.compact(spark, root, target=1 << 20, unit=1024)
    after = sharding.manifest(spark, root)
    assert last == 6 and after.count() < before.count()
    assert after.selectExpr("sum(docs)").first()[0] == 1000
    assert key(sharding.read(spark, root)) == key(documents(spark, whole))
    sharding.vacuum(spark, root)
    assert key(sharding.read(spark, root)) == key(documents(spark, whole))


def test_of_racing_writers_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    sharding.append(spark, root, documents(spark, rows(10)))
    names = sharding.manifest(spark, root)
    told = []

    def write():
        try:
            told.append(sharding._commit(spark, root, names, 1, sharding.schema_of(spark, root)))
        except sharding.Conflict:
            told.append(None)

    writers = [threading.Thread(target=write) for _ in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(told, key=str) == [2, *[None] * 5] and sharding.version(spark, root) == 2
    with pytest.raises(sharding.Conflict):
        sharding._commit(spark, root, names, 1, sharding.schema_of(spark, root))
    assert key(sharding.read(spark, root)) == key(documents(spark, rows(10)))


def test_vacuum_spares_what_may_be_committed(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    sharding.append(spark, root, documents(spark, rows(10)))
    documents(spark, rows(5)).write.parquet(f"{root}/data/uncommitted")
    sharding.vacuum(spark, root)
    assert {p.name for p in (tmp_path / "store/data").iterdir()} > {"uncommitted"}
    assert sharding.read(spark, root).count() == 10  # the uncommitted files aren't read
    sharding.vacuum(spark, root, 0)
    assert "uncommitted" not in {p.name for p in (tmp_path / "store/data").iterdir()} and sharding.read(spark, root).count() == 10


def merged(shards, target, fan_in):
    """Runs by the definition: of each tier's small shards, in order, by the target that their sums fall in."""
    out, sums = {}, {}
    for s in sorted((s for s in shards if s.bytes * 2 < target), key=lambda s: (s.added, s.shard)):
        sums[s.tier] = sums.get(s.tier, 0) + s.bytes
        out.setdefault((s.tier, (sums[s.tier] - 1) // target), []).append(s)
    return {frozenset(s.path for s in r) for r in out.values() if len(r) >= fan_in or (len(r) > 1 and 2 * sum(s.bytes for s in r) >= target)}


def test_which_shards_are_merged(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    for k, n in enumerate([3, 200, 5, 90, 4, 700, 6]):
        sharding.append(spark, root, documents(spark, rows(n, 1000 * k)).repartition(2), unit=2048)
    before = {s.path: s for s in sharding.manifest(spark, root).collect()}
    target = 60_000
    runs = merged(before.values(), target, 4)
    docs_of = {r: sum(before[p].docs for p in r) for r in runs}
    sharding.compact(spark, root, target=target, unit=2048)
    after = sharding.manifest(spark, root).collect()
    kept = {s.path for s in after if s.path in before}
    assert runs and kept == set(before) - set().union(*runs)
    assert sorted(s.docs for s in after if s.path not in before) == sorted(docs_of.values())


def test_same_arrivals_same_names(spark, tmp_path):
    docs = documents(spark, rows(300)).repartition(3)
    names = lambda k: sorted((r.doc_id, r.shard) for r in sharding.sharded(docs, f"file://{tmp_path}/{k}", target=20_000, unit=1024).collect())
    assert names(1) == names(2)


def test_files_come_near_the_target(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    import random

    rng = random.Random(1)
    for k in range(8):
        part = [(1000 * k + i, "".join(rng.choice("abcdefghijklmnop") for _ in range(500))) for i in range(300)]
        sharding.append(spark, root, documents(spark, part).coalesce(1), unit=1024)
    target = 300_000
    sharding.compact(spark, root, target=target, unit=1024)
    sizes = [r.bytes for r in sharding.manifest(spark, root).collect()]
    assert max(sizes) < 1.5 * target and sum(s > 0.4 * target for s in sizes) >= 1


def test_digest_and_empty(spark):
    docs = documents(spark, rows(50) + rows(3))
    out = sharding.sharded(docs, target=1 << 20, unit=1024)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in rows(50) + rows(3)) and "text" not in out.columns and {"shard", "tier", "version"} <= set(out.columns)
    assert sharding.sharded(docs.limit(0)).count() == 0


@pytest.mark.parametrize("wider_first", [True, False])
def test_arrivals_of_other_widths_lose_nothing(spark, tmp_path, wider_first):
    root = f"file://{tmp_path}/store"
    narrow = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    wide = narrow.selectExpr("doc_id + 100 as doc_id", "text", "cast(doc_id as int) as extra", "map('k', text) as `a.b`", "'s' as Shard")
    for part in (wide, narrow) if wider_first else (narrow, wide):
        sharding.append(spark, root, part.repartition(3))
    for _ in range(2):
        rows = {r["doc_id"]: r for r in sharding.read(spark, root).collect()}
        assert len(rows) == 80
        assert all(rows[i]["extra"] is None and rows[i]["a.b"] is None for i in range(40))
        assert all(rows[100 + i]["extra"] == i and rows[100 + i]["a.b"] == {"k": f"text {i}"} and rows[100 + i]["Shard"] == "s" for i in range(40))
        sharding.compact(spark, root, target=1 << 20, fan_in=2)
        sharding.vacuum(spark, root, 0)
    assert {f.name for f in sharding.schema_of(spark, root)} == {"doc_id", "text", "extra", "a.b", "Shard"}
    assert sharding.version(spark, root) == 3 and sharding.manifest(spark, root).count() == 1


def test_another_type_is_an_error(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    sharding.append(spark, root, docs)
    with pytest.raises(ValueError, match="DOC_ID"):
        sharding.append(spark, root, docs.selectExpr("cast(doc_id as string) as DOC_ID", "text"))
    assert sharding.version(spark, root) == 1 and sharding.read(spark, root).count() == 1
