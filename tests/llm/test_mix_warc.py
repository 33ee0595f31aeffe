"""Mixing, WARC fixity and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitchloom.llm import common, mixing, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        over = sum(weight[s] for s in names if s not in full)
        share = {s: most * sizes[s] if s in full else left * weight[s] / over for s in names}
        above = {s for s in names if s not in full and share[s] > most * sizes[s] + 1e-9}
        if not above:
            return share
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 1000, "c": 1, None: 5}, {"a": 5}, {"a": 0, "b": 9, "c": 3}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 1}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, again = (mixing.allot(docs).collect() for _ in range(2))
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        taken, target = sum(r.size * r.times for r in own), own[0].target
        assert abs(taken - target) <= 0.02 * target + 5
        assert max(r.times for r in own) <= 3 and max(r.times for r in own) - min(r.times for r in own) <= 1


def test_mix_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    r = con.execute(queries.ORACLE_SQL["op5_mix"])
    columns = [c[0] for c in r.description]
    assert sorted(map(tuple, queries.QUERIES["op5_mix"](spark, SF).select(*columns).collect())) == sorted(r.fetchall())


def test_empty_documents_are_not_taken_beyond_whole_epochs(spark):
    """Three whole epochs leave no budget, so no document is taken a fourth time, empty ones included."""
    docs = spark.createDataFrame([(i, "" if i % 8 else "word " * 5, "small") for i in range(32)] + [(100 + i, "word " * 50, "large") for i in range(40)], "doc_id long, text string, source string")
    rows = mixing.allot(docs, seed="x").collect()
    assert max(r.times for r in rows) <= 3
    assert mixing.mix(docs, seed="x").count() == sum(r.times for r in rows)


def test_a_long_document_at_the_budget_leaves_no_large_gap(spark):
    """Many short documents behind a long one that does not fit fill what it leaves."""
    docs = spark.createDataFrame([(i, "w " * (5000 if i % 20 == 0 else 30), "a" if i < 400 else "b") for i in range(500)], "doc_id long, text string, source string")
    for seed in "abcd":
        by = defaultdict(list)
        for r in mixing.allot(docs, seed=seed).collect():
            by[r.source].append(r)
        for own in by.values():
            assert abs(sum(r.size * r.times for r in own) - own[0].target) <= 31


def test_sampling_order(spark):
    """Heavier documents come earlier, by the ratio of their weights."""
    df = spark.range(4000).select(mixing.sampling_key(F.col("id").cast("string"), F.lit(1.0), "s").alias("a"), mixing.sampling_key((F.col("id") + 4000).cast("string"), F.lit(0.25), "s").alias("b"))
    assert df.where("a < b").count() / 4000 == pytest.approx(0.8, abs=0.03)


def test_mix_of_odd_documents(spark, odd_documents, no_documents):
    rows = mixing.allot(odd_documents).collect()
    assert len(rows) == 12 and all(r.times <= 3 for r in rows)
    out = mixing.mix(odd_documents)
    assert out.columns == odd_documents.columns
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r.times
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in taken.items() if v})
    assert mixing.allot(no_documents).count() == 0 and mixing.mix(no_documents).count() == 0


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "é" * i) for i in range(70)] + [(None, None, None), (5, "again", ""), (300, "u", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark, pages):
    root = common.shared_dir(spark, "w")
    inventory, files = warc.write_archives(pages, [root], 3)
    got = sorted(((r.page_id is None, r.page_id, r.url, r.html) for r in warc.read_archives(inventory, files).collect()), key=repr)
    assert got == sorted(((r.page_id is None, r.page_id, r.url or "", r.html or "") for r in pages.collect()), key=repr)
    assert files.count() <= 3 and inventory.columns == ["archive", "record", "page_id", "offset", "length", "size", "digest"]


def test_pages_with_other_columns_and_a_long_one(spark):
    rows = [(1, "u", "x" * 3_000_000, "a", 7, 0.5), (2, "v", "é", None, None, None), (2, "w", "é", "b", 1, 1.0)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, archive string, record int, OFFSET double")
    found = warc.fixity(odd, 2, F.col("page_id") == 1).collect()
    assert sorted((r.page_id, r.mismatch) for r in found) == [(1, True), (2, False), (2, False)]
    assert all(r.digest == __import__("hashlib").sha256(warc.record(p, u, h)).hexdigest() for r in found for p, u, h, *_ in rows if r.page_id == p == 1)


def test_an_id_of_many_pages_fills_several_archives(spark):
    many = spark.createDataFrame([(4, f"http://x/{i}", "p") for i in range(400)] + [(i, "u", "q") for i in range(50)], "page_id long, url string, html string")
    inventory, files = warc.write_archives(many, [common.shared_dir(spark, "w")], 8)
    own = Counter(r.archive for r in inventory.where("page_id = 4").collect())
    assert len(own) >= 5 and max(own.values()) < 150
    assert warc.read_archives(inventory, files).count() == 450


def test_audit_finds_just_the_damage(spark, pages):
    root = common.shared_dir(spark, "w")
    inventory, files = warc.write_archives(pages, [f"{root}/a", f"{root}/b"], 2)
    intact = warc.tree(inventory, files, 0)
    assert warc.audit(intact, warc.tree(inventory, files, 1)).count() == 0
    assert warc.damage(inventory, files, 1, F.col("page_id").isin(3, 41, 300)) == 3
    assert warc.damage(inventory, files, 1, F.col("page_id").isin(3, 41, 300)) == 3  # a repeated task changes nothing
    broken = warc.tree(inventory, files, 1)
    found = warc.audit(intact, broken).join(inventory, ["archive", "record"])
    assert sorted(r.page_id for r in found.collect()) == [3, 41, 300]
    roots = [warc.replica_root(warc.archive_roots(t)) for t in (intact, broken, intact)]
    assert roots[0] == roots[2] != roots[1]
    # a replica cut short
    paths = files.first().files
    store, path = common.open_store(paths[1])
    with store.open_input_stream(path) as f:
        held = f.read()
    with store.open_output_stream(path) as f:
        f.write(held[: len(held) // 2])
    assert warc.audit(intact, warc.tree(inventory, files, 1)).count() > 10
    # and one that is gone
    store.delete_file(path)
    archive = files.first().archive
    lost = warc.audit(intact, warc.tree(inventory, files, 1))
    assert lost.where(F.col("archive") == archive).count() == inventory.where(F.col("archive") == archive).count()


def test_trees_against_brute_force(spark, pages):
    """Every node by hashing, level by level, and the audit as the difference of all leaves."""
    import hashlib

    root = common.shared_dir(spark, "w")
    inventory, files = warc.write_archives(pages, [f"{root}/a"], 3)
    got = {(r.archive, r.level, r.node): (r.first, r.past, r.hash) for r in warc.tree(inventory, files, 0).collect()}
    expected = {}
    for f in files.collect():
        store, path = common.open_store(f.files[0])
        with store.open_input_stream(path) as source:
            held = source.read()
        own = sorted((r.record, r.offset, r.length) for r in inventory.where(F.col("archive") == f.archive).collect())
        level, nodes = 0, [(o, o + n, hashlib.sha256(held[o : o + n]).hexdigest()) for _, o, n in own]
        while True:
            expected |= {(f.archive, level, i): x for i, x in enumerate(nodes)}
            if len(nodes) == 1 and level:
                break
            parts = [nodes[i : i + warc.FANOUT] for i in range(0, len(nodes), warc.FANOUT)]
            nodes = [(p[0][0], p[-1][1], hashlib.sha256("".join(f"{a}-{b}:{x};" for a, b, x in p).encode()).hexdigest()) for p in parts]
            level += 1
    assert got == expected


def test_fixity_of_nothing(spark, pages):
    assert warc.fixity(pages.limit(0), 3, F.lit(True)).count() == 0
    rows = warc.fixity(pages, 3, F.coalesce(common.id_fold("page_id", 10) == 0, F.lit(False))).collect()
    assert len(rows) == 73
    assert all(r.mismatch == (r.page_id is not None and zlib.crc32(str(r.page_id).encode()) % 10 == 0) for r in rows)


def test_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "mix", "pack"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = common.durable(stage(spark, kept, SF), name)
        assert after.columns == docs.columns
        before, now = Counter(map(tuple, kept.collect())), Counter(map(tuple, after.collect()))
        assert now <= before and sum(now.values()) > 0.6 * sum(before.values())
        kept = after
    toxic = {r.doc_id for r in toxicity.query(spark, SF).where("score > 0.95").collect()}
    assert not toxic & {r.doc_id for r in kept.collect()}
    mixed = common.durable(corpus_pipeline.STAGES[3][1](spark, kept, SF), "mix")
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r.doc_id for r in mixed.collect())
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("past")).collect()
    assert all(r.n == r.past <= 4096 for r in fill) and len(fill) <= math.ceil(sum(r.n for r in fill) / 4096) * 1.05 + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length").collect()))
    keys = corpus_pipeline.run(spark, SF).select("doc_id", "copy", "piece")
    assert keys.count() == keys.distinct().count()


def pipeline_over(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_pipeline_of_odd_documents(spark, tmp_path, odd_documents):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    found = pipeline_over(spark, tmp_path, odd_documents, labels)
    assert found and all(r.length > 0 and r.offset + r.length <= 4096 for r in found)
    assert not {2, 3, 7} & {r.doc_id for r in found}  # no letter, no language
    assert 5 not in {r.doc_id for r in found}  # the text of 1


def test_pipeline_of_nothing(spark, tmp_path, no_documents):
    assert pipeline_over(spark, tmp_path, no_documents, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == []
