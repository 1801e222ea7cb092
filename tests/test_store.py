"""The store of segments: changes, readers, tombstones, pruned searches, pages; and searches by blocks and lists."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from clauseworks.operators import dense, embedding, ivf, lexical, postings
from clauseworks.plans import index

FIELDS = "id string, act_name string, provision_type string, document string, text string, act_ord int, kind_ord int, prov_ord int"


def rows_of(spark, ids, change=""):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["common"] * 20
    texts = {i: " ".join(r.choice(words) for _ in range(r.randrange(3, 30))) for i in range(2000)}
    rows = [(f"i{i:05d}", f"Act {i // 40:03d}", ["section", "subsection"][i % 2], texts[i] + change, texts[i] + change, i // 40, 0, i) for i in ids]
    return spark.createDataFrame(rows, FIELDS)


def size_of(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store") / "c")
    index.upsert(rows_of(spark, range(1200)), folder, embedding.HashingEmbedder(8))
    return folder


def everything(c):
    return {r["id"]: r["document"] for r in c.payload.collect()}


def test_a_small_change_writes_little_and_readers_go_on(spark, store):
    before = index.read(spark, store)
    held, was, size = before.payload, everything(before), size_of(store)
    index.upsert(rows_of(spark, range(600, 612), " changed"), store, embedding.HashingEmbedder(8))
    assert size_of(store) - size < size / 8  # each file has a footer, which weighs at 12 rows
    after = index.read(spark, store)
    now = everything(after)
    assert len(now) == 1200 and sum(now[i] != was[i] for i in was) == 12 and after.n == 1200
    assert {r["id"]: r["document"] for r in held.collect()} == was  # a table that was read before the change
    assert everything(index.read(spark, store, before.version)) == was
    assert after.vectors.count() == 1200 and after.vectors.select("id").distinct().count() == 1200


def brute(c, terms, keep=None):
    """By the texts that count, without any index."""
    rows = c.payload.select("id", "document", "provision_type", "act_name")
    scores = lexical.search_texts(rows, terms, keep, text="document")
    return sorted(((round(r["score"], 6), r["id"]) for r in scores.collect()), key=lambda x: -x[0])


@pytest.mark.parametrize(
    "keep, where",
    [
        (None, None), ({"act_name": "Act 015"}, "act_name = 'Act 015'"),
        ({"act_name": "Act 002", "provision_type": "section"}, "act_name = 'Act 002' and provision_type = 'section'"), ({"provision_type": "none"}, "false"),
    ],
)
def test_search_by_blocks_counts_what_counts(spark, store, keep, where):
    index.upsert(rows_of(spark, range(590, 640), " common end"), store, embedding.HashingEmbedder(8))
    c = index.read(spark, store)
    for terms in (["common", "w3"], ["end"], ["w1", "w2", "w3", "w4"], ["nowhere"]):
        met = {}
        got = c.fetch(c.search_words(terms, 10, keep, met)).collect()
        want = brute(c, terms, None if where is None else F.expr(where))
        assert sorted((-round(r["score"], 6) for r in got)) == [-s for s, _ in want[:10]]
        assert {r["id"] for r in got} <= {i for s, i in want if s >= (want[9][0] if len(want) > 9 else 0)}
        assert not met or met["read"] <= met["blocks"]
    stats = c.stats(["common", "end"])
    assert stats.df["end"] == 50 and stats.n == 1200


def test_compact_and_vacuum(spark, store):
    index.upsert(rows_of(spark, range(1190, 1230), " tail"), store, embedding.HashingEmbedder(8))
    before = index.read(spark, store)
    was, ranked = everything(before), [tuple(r) for r in before.search_words(["common", "tail"], 8).select("tie", "score").collect()]
    vectors = {r["id"]: r["vector"] for r in before.vectors.collect()}
    index.compact(spark, store)
    c = index.read(spark, store)
    assert len(c.manifest["segments"]) == 1 and c.dead is None and everything(c) == was and c.n == len(was)
    assert {r["id"]: r["vector"] for r in c.vectors.collect()} == vectors
    assert [tuple(r) for r in c.search_words(["common", "tail"], 8).select("tie", "score").collect()] == ranked
    assert {r["term"]: r["df"] for r in c.term_stats().collect()} == {r["term"]: r["df"] for r in before.term_stats().collect()}
    assert index.vacuum(spark, store) == [] and everything(before) == was  # nothing is old enough
    assert index.vacuum(spark, store, 0) and index.versions(spark, store) == [c.version]
    assert everything(index.read(spark, store)) == was


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    folder = str(tmp_path / "c")
    index.upsert(rows_of(spark, range(3)), folder, embedding.HashingEmbedder(8))
    c = index.read(spark, folder)
    with pytest.raises(index.Conflict):
        index._commit(spark, folder, c.version, {**c.manifest, "n": 0})
    assert index.read(spark, folder).n == 3 and index.versions(spark, folder) == [1]


def test_of_repeated_ids_the_last_counts(spark, tmp_path):
    folder, rows = str(tmp_path / "c"), rows_of(spark, [1, 2])
    twice = rows.unionByName(rows.withColumn("prov_ord", F.col("prov_ord") + 10).withColumn("document", F.lit("later")))
    index.upsert(twice, folder, embedding.HashingEmbedder(8))
    assert everything(index.read(spark, folder)) == {"i00001": "later", "i00002": "later"}
    index.upsert(rows.limit(0), folder, embedding.HashingEmbedder(8))
    assert index.read(spark, folder).n == 2


def test_pages_make_the_whole(spark, store):
    c, seen, cursor, pages = index.read(spark, store), [], None, 0
    while True:
        page, cursor = c.scroll(cursor, 250)
        seen += [r["id"] for r in page]
        pages += 1
        if cursor is None:
            break
    assert pages == -(-c.n // 250) and len(seen) == c.n == len(set(seen))
    assert seen == [r["id"] for r in c.payload.orderBy("act_name", "act_ord", "kind_ord", "prov_ord", "id").collect()]
    some, _ = c.scroll(None, 5, F.col("act_name") == "Act 003")
    assert [r["prov_ord"] for r in some] == [120, 121, 122, 123, 124]


def test_a_filtered_search_shuffles_no_vectors(spark, tmp_path):
    folder = str(tmp_path / "c")
    index.upsert(rows_of(spark, range(200)), folder, embedding.HashingEmbedder(8))
    found = index.read(spark, folder).search_vector([1.0] * 8, 5, {"act_name": "Act 002", "provision_type": "section"})
    plan = found._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "EqualTo(act_name,Act 002)" in plan
    want = [r["score"] for r in found.collect()]
    texts = rows_of(spark, range(200)).where("act_name = 'Act 002' and provision_type = 'section'").select("id", F.col("document").alias("text"))
    exact = dense.cosine_scores(embedding.embed_texts(texts, embedding.HashingEmbedder(8)), [1.0] * 8).orderBy(F.desc("score")).limit(5)
    assert want == [round(r["score"], 9) for r in exact.collect()]


def clustered(spark, n=4000, dim=16, groups=40):
    r = np.random.default_rng(2)
    centers = r.standard_normal((groups, dim))
    x = centers[np.arange(n) % groups] + 0.15 * r.standard_normal((n, dim))
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(n, None), (n + 1, [0.0] * dim)]
    return x, spark.createDataFrame(rows, "id long, vector array<float>")


def test_lists_are_pruned_and_find_the_nearest(spark, tmp_path):
    x, v = clustered(spark)
    centroids = ivf.train(v, 32)
    ivf.filed(v, centroids).repartition("list").write.partitionBy("list").parquet(str(tmp_path / "v"))
    filed = spark.read.parquet(str(tmp_path / "v"))
    stats, unit, hit = ivf.list_stats(filed), x / np.linalg.norm(x, axis=1, keepdims=True), 0
    files = filed.inputFiles()
    for q in range(0, 400, 20):
        best = set(np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist())
        met = {}
        found = ivf.search(filed, centroids, None, x[q].tolist(), 10, 3, met=met)
        assert "PartitionFilters: [list#" in found._jdf.queryExecution().toString() and sum(f"list={i}/" in f for i in met["read"] for f in files) * 5 < len(files)
        hit += len(best & {r["id"] for r in found.orderBy(F.desc("score")).limit(10).collect()})
    assert hit >= 0.9 * 200
    met = {}
    exact = ivf.search(filed, centroids, stats, x[7].tolist(), 10, 1, exact=True, met=met).orderBy(F.desc("score"), "id").limit(10)
    assert [r["id"] for r in exact.collect()] == [r["id"] for r in dense.cosine_scores(v, x[7].tolist()).orderBy(F.desc("score"), "id").limit(10).collect()]
    assert len(met["read"]) < 16


def test_a_store_with_lists(spark, tmp_path):
    folder = str(tmp_path / "c")
    index.upsert(rows_of(spark, range(400)), folder, embedding.HashingEmbedder(8), lists=8)
    index.upsert(rows_of(spark, range(390, 420), " w1 w2"), folder, embedding.HashingEmbedder(8))
    c = index.read(spark, folder)
    [q] = embedding.HashingEmbedder(8).embed(["w1 w2 w3"], "query")
    every = c.search_vector(q, 10)
    assert [r["score"] for r in c.search_vector(q, 10, probes=len(c.manifest["centroids"])).collect()] == [r["score"] for r in every.collect()]
    assert c.n == 420 and c.vectors.count() == 420


def test_many_queries_equal_one_by_one(spark, tmp_path):
    rows = rows_of(spark, range(500)).select(F.substring("id", 2, 9).cast("long").alias("doc"), F.substring("id", 2, 9).cast("long").alias("tie"), "text")
    blocks = postings.build(rows)
    postings.write(blocks, str(tmp_path / "b"))
    blocks = spark.read.parquet(str(tmp_path / "b"))
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    n, avgdl = rows.count(), rows.agg(F.avg(F.size(F.split("text", " ")))).first()[0]
    queries = {i: [f"w{i}", f"w{i + 1}", "common"] for i in range(12)} | {99: ["nowhere"]}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "qid long, term string")
    found = postings.search_many(blocks, asked, postings.Stats(n, avgdl), df, 7)
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["tie"], r["score"]))
    known = {r["term"]: r["df"] for r in df.collect()}
    for q, terms in queries.items():
        stats = postings.Stats(n, avgdl, {t: known[t] for t in terms if t in known})
        met = {}
        want = [(i + 1, r["tie"], round(r["score"], 6)) for i, r in enumerate(postings.search(blocks, stats, 7, first=1, met=met).collect())] if stats.df else []
        assert sorted(got.get(q, [])) == want


def test_many_vectors_equal_one_by_one(spark, monkeypatch):
    x, v = clustered(spark, 300, 8, 10)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 64)
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 4)
    v = v.unionByName(v.where("id < 5").withColumn("id", F.col("id") + 1000))  # ties
    asked = v.where("id % 30 = 0").select(F.col("id").alias("qid"), "vector")
    got = {}
    for r in dense.search_many(v, asked, 6).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    assert len(got) == asked.count() - 1  # one has no vector
    for q in (0, 30, 270):
        one = dense.cosine_scores(v, x[q].tolist()).select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(6)
        assert [(i, pytest.approx(s, abs=2e-9)) for _, i, s in sorted(got[q])] == [(r["id"], r["score"]) for r in one.collect()]


def test_postings_are_made_without_a_shuffle(spark, tmp_path):
    rows = rows_of(spark, range(1500)).select(F.monotonically_increasing_id().alias("doc"), F.substring("id", 2, 9).cast("long").alias("tie"), "text", "act_name")
    made = postings.build(rows, "act_name")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    postings.write(made, str(tmp_path / "b"), "act_name")
    blocks = spark.read.parquet(str(tmp_path / "b"))
    got = blocks.select("term", F.explode("posts").alias("p")).select("term", "p.tie", "p.tf", "p.dl").collect()
    want = [(w, r["tie"], r["text"].split().count(w), len(r["text"].split())) for r in rows.collect() for w in set(r["text"].split())]
    assert sorted(map(tuple, got)) == sorted(want)


def test_tombstones_and_merges_shuffle_no_text(spark, tmp_path):
    a, b, out = (str(tmp_path / x) for x in "abc")
    index.upsert(rows_of(spark, range(300)), a, embedding.HashingEmbedder(8))
    index.upsert(rows_of(spark, range(100, 200), " newer"), a, embedding.HashingEmbedder(8))
    index.upsert(rows_of(spark, range(150, 350), " last"), b, embedding.HashingEmbedder(8))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = index.read(spark, a).payload.select("id", "document")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "document" in plan
    assert index.merge(spark, [a, b], out) == 500
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    texts = {f"i{i:05d}": r for i, r in enumerate(x["document"] for x in rows_of(spark, range(350)).collect())}
    c = index.read(spark, out)
    assert everything(c) == {i: t + (" last" if int(i[1:]) >= 150 else " newer" if int(i[1:]) >= 100 else "") for i, t in texts.items()}
    assert c.vectors.count() == 350 == c.vectors.select("id").distinct().count()


def test_postings_come_in_sorted_runs_and_count_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RUN_BYTES", 20_000)
    monkeypatch.setattr(postings, "OUT_BLOCKS", 100)
    rows = rows_of(spark, range(1500)).select(F.monotonically_increasing_id().alias("doc"), F.substring("id", 2, 9).cast("long").alias("tie"), "text", "act_name").coalesce(1)
    words = rows.select("doc", "tie", "act_name", F.split("text", " ").alias("ts")).toArrow().combine_chunks()
    runs = list(postings._runs(iter(words.to_batches(100))))
    assert sum(b.num_rows for some in runs for b in some) == 1500 and len(runs) > 2
    for some in runs:
        made = list(postings._inverted(pa.Table.from_batches(some), "act_name", ["tie"]))
        places = [(r["term"], r["act_name"], r["range"]) for b in made for r in b.select(["term", "act_name", "range"]).to_pylist()]
        assert places == sorted(places) and len(made) > 1 and max(b.num_rows for b in made) == 100
    seen = Observation()
    postings.write(postings.build(rows, "act_name", seen=seen), str(tmp_path / "b"), "act_name")
    lengths = [len(r["text"].split()) for r in rows.collect()]
    assert seen.get == {"n": 1500, "avgdl": pytest.approx(sum(lengths) / 1500)}
    assert sum(r["n"] for r in spark.read.parquet(str(tmp_path / "b")).select("n").collect()) == sum(len(set(r["text"].split())) for r in rows.collect())


@pytest.mark.parametrize("most", [1000, 0])
def test_many_queries_shuffle_no_posting_by_term(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(postings, "MAX_TERMS", most)
    rows = rows_of(spark, range(200)).select(F.substring("id", 2, 9).cast("long").alias("doc"), F.substring("id", 2, 9).cast("long").alias("tie"), "text")
    postings.write(postings.build(rows), str(tmp_path / "b"))
    blocks = spark.read.parquet(str(tmp_path / "b"))
    asked = spark.createDataFrame([(1, "w1"), (1, "common"), (2, "w2"), (3, "nowhere")], "qid long, term string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = postings.search_many(blocks, asked, postings.Stats(200, 16.0), blocks.groupBy("term").agg(F.sum("n").alias("df")), 3)
    plan, got = found._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, found.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert len(semi) == 2 and all(("BroadcastHashJoin" in line) == bool(most) for line in semi)
    assert [r[0] for r in got] == [1, 1, 1, 2, 2, 2]


def test_terms_of_tombstones_are_counted_by_run(spark, monkeypatch):
    monkeypatch.setattr(postings, "RUN_BYTES", 20_000)
    rows = rows_of(spark, range(700)).select("text").unionByName(spark.createDataFrame([(None,), ("",), ("Twice twice, once",)], "text string"))
    made = postings.term_counts(rows)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in rows.collect():
        for w in set((r["text"] or "").lower().replace(",", "").split()):
            want[w] = want.get(w, 0) + 1
    assert {r["term"]: r["df"] for r in made.collect()} == want and want["twice"] == 1
    assert postings.term_counts(rows.where("text is null")).collect() == [] == postings.term_counts(rows.limit(0)).collect()


def test_a_segment_cuts_its_texts_once_and_lengths_stay_exact(spark, tmp_path, monkeypatch):
    def twice(text):
        raise AssertionError("texts are cut where postings are made")

    monkeypatch.setattr(index, "tokens", twice, raising=False)
    at = str(tmp_path / "c")
    for ids, change in ((range(300), ""), (range(100, 200), " newer and LONGER, longer"), (range(150, 350), " last")):
        index.upsert(rows_of(spark, ids, change), at, embedding.HashingEmbedder(8))
    c = index.read(spark, at)
    words = [r["document"].replace(",", "").split() for r in c.payload.collect()]
    assert (c.n, c.manifest["length"]) == (350, sum(map(len, words)))
    assert c.stats(["longer", "common"]).df == {"longer": 50.0, "common": float(sum("common" in w for w in words))}
    got = {r["term"]: (r["df"], r["cf"]) for r in postings.term_counts(rows_of(spark, range(5), " twice twice")).collect()}
    assert got["twice"] == (5, 10)
    index.upsert(rows_of(spark, []), str(tmp_path / "none"), embedding.HashingEmbedder(8))
    assert index.read(spark, str(tmp_path / "none")).manifest["length"] == 0
