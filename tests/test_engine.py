"""Corpus to answers: parsing, ingest, search, look-ups, shards, cache, rendering, command line, streaming."""

import io
import json
import math
import os
import threading
from datetime import datetime
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from clauseworks.operators import dense, embedding, fusion, lexical
from clauseworks.plans import cli, index, render, service, shards
from clauseworks.plans.engine import Engine, NotFound
from clauseworks.sources import corpus, markup
from clauseworks.streaming.ingest import embed_stream, late_rows, upsert_stream

NS = 'xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"'


def act(uri: str, sections: str, attachments: str = "") -> str:
    meta = f'<meta><identification><FRBRExpression><FRBRuri value="{uri}"/></FRBRExpression></identification></meta>' if uri else ""
    return f"<akomaNtoso {NS}><act>{meta}<body>{sections}</body>{attachments}</act></akomaNtoso>"


PRIVACY = act(
    "/akn/au/act/1988/119/eng@2026-01-01",
    '<section eId="sec-10"><num>10</num><heading> </heading><content><p>Agencies hold records of personal information.</p></content></section>'
    '<section eId="sec-6"><num>6</num><heading>Meaning of personal information</heading>'
    '<subsection eId="sec-6__subsec-1"><content><p>Personal information means information about an individual.</p></content></subsection>'
    '<subsection eId="sec-6__subsec-2"><content><p>Short.</p></content></subsection></section>',
    '<attachments><attachment><hcontainer name="schedule" eId="schedule-1"><hcontainer name="clause" eId="schedule-1__clause-1"><num>1</num><heading>APP 1</heading>'
    "<content><p>See the Spam Act 2003 and the Lost Act 1900.</p><table><tr><td>a</td><td/><td>b</td></tr><caption>no</caption></table></content>"
    '<hcontainer name="clause" eId="inner"><num>9</num></hcontainer></hcontainer></hcontainer></attachment></attachments>',
)
SPAM = act("/akn/au/act/2003/129", '<section eId="sec-1"><num>1</num><content><p>Unsolicited <b>commercial</b> messages must not be sent<i>!</i> to anyone.</p></content></section>')
BARE = act("", "<part><section><content><p>A section without an id or a number, in a part.</p></content></section></part><subsection eId='x__subsec-1'><p>A subsection outside any section at all.</p></subsection>")


@pytest.fixture(scope="module")
def corpus_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    for name, xml in (("privacy", PRIVACY), ("spam", SPAM), ("bare", BARE)):
        (d / f"{name}.xml").write_text(xml, encoding="utf-8")
    index = {
        "privacy": {"name": "Privacy Act 1988", "xml_path": "privacy.xml", "frbr_expression_uri": "/akn/au/act/1988/119"},
        "nameless": {"xml_path": "none.xml"},
        "spam": {"name": "Spam Act 2003", "xml_path": "spam.xml", "frbr_expression_uri": "/akn/au/act/2003/129"},
        "bare": {"name": "Bare Act 2000", "xml_path": "bare.xml"},
    }
    (d / "index.json").write_text(json.dumps({"acts": index}), encoding="utf-8")
    return str(d)


def test_parse_privacy():
    rows = markup.provisions(PRIVACY.encode())
    assert [(r[3], r[4], r[5], r[6]) for r in rows] == [
        ("sec-10", "10", "section", ""),
        ("sec-6", "6", "section", "Meaning of personal information"),
        ("sec-6__subsec-1", "6(1", "subsection", None),
        ("schedule-1__clause-1", "1", "schedule_clause", "APP 1"),
    ]
    assert rows[3][7] == "1 APP 1 See the Spam Act 2003 and the Lost Act 1900. a | b 9"
    assert rows[1][7].endswith("Short.") and {r[0] for r in rows} == {"/akn/au/act/1988/119/eng@2026-01-01"}


def test_parse_bare():
    rows = markup.provisions(BARE.encode())
    assert [(r[0], r[3], r[4], r[5]) for r in rows] == [("", "", "", "section"), ("", "x__subsec-1", "(1", "subsection")]


def test_mixed_content_keeps_its_order():
    assert markup.provisions(SPAM.encode())[0][7] == "1 Unsolicited commercial messages must not be sent ! to anyone."


def test_index_and_refs(spark, corpus_dir):
    index = corpus.read_index(spark, corpus_dir)
    assert [(r["act_ord"], r["name"]) for r in index.orderBy("act_ord").collect()] == [(0, "Privacy Act 1988"), (1, "Spam Act 2003"), (2, "Bare Act 2000")]
    # one shard alone still resolves what the whole index has
    rows = corpus.read_provisions(spark, corpus_dir, index, corpus.shard(index, 0, 1))
    refs = {r["eid"]: r["refs"] for r in rows.collect()}
    assert refs["schedule-1__clause-1"] == ["/akn/au/act/2003/129", "unresolved:Lost Act 1900"]
    assert len(refs) == 4


@pytest.fixture(scope="module")
def engine(spark, corpus_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    e = Engine(spark, str(d / "s"))
    got = e.ingest(corpus_dir, str(d / "cache"))
    assert got["provisions"] == 7 and got["acts"] == 3 and got["missing"] == []
    e.cache = str(d / "cache")
    return e


def test_search(engine):
    hits = engine.search_provisions("personal information individual", 3).orderBy("rank").collect()
    assert [h["rank"] for h in hits] == [1, 2, 3] and hits[0]["eid"].startswith("sec-6")
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    only = engine.search_provisions("messages", 5, act="Spam Act 2003").collect()
    assert {h["act_name"] for h in only} == {"Spam Act 2003"}
    kinds = engine.search_provisions("information", 5, act="", provision_type="subsection").collect()
    assert kinds and {h["provision_type"] for h in kinds} == {"subsection"}
    clause = engine.search_provisions("spam lost", 1).first()
    assert clause["refs"] == ["/akn/au/act/2003/129"]


def test_search_acts_and_text(engine):
    assert engine.search_acts("privacy act 1988", 1).first()["act_name"] == "Privacy Act 1988"
    assert engine.search_text("spam lost act", 1).startswith("[Privacy Act 1988 1988 Sch 1 cl 1 (schedule-1__clause-1) score=0.")
    assert engine.search_text("zzz", 1, act="No such Act") == render.NOTHING


def test_lookups(engine):
    assert engine.act_metadata("Privacy Act 1988")["section_count"] == 2
    assert engine.act_metadata("Privacy Act 1988")["as_at_date"] == "2026-01-01"
    with pytest.raises(NotFound):
        engine.act_metadata("No such Act")
    assert [r["eid"] for r in engine.act_provisions("Privacy Act 1988").collect()] == ["sec-6", "sec-10", "schedule-1__clause-1", "sec-6__subsec-1"]
    assert engine.act_provisions("No such Act").count() == 0 and engine.act_text("No such Act") == ""
    text = engine.act_text("Privacy Act 1988")
    assert text.startswith("6 Meaning") and text.count("\n\n") == 3
    assert len(engine.act_provisions("Privacy Act 1988", cap=1).collect()) == 1


def test_requests_are_answered(engine):
    ask = lambda target: service.respond(service.Service(engine), target)
    status, kind, body = ask("/search?q=personal+information&limit=2&act=Privacy%20Act%201988&provision_type=section")
    hits = json.loads(body)["results"]
    assert (status, kind) == (200, service.JSON) and 0 < len(hits) <= 2
    assert set(hits[0]) == {"act_name", "frbr_uri", "eid", "provision_num", "provision_type", "heading", "text", "refs", "score"}
    assert {h["provision_type"] for h in hits} == {"section"}
    assert [ask(t)[0] for t in ("/search", "/search?q=a&limit=x", "/search?q=a&limit=0")] == [422] * 3
    assert [ask(t)[0] for t in ("/", "/legislation", "/legislation/No%20such%20Act", "/legislation/a/b")] == [404] * 4
    assert json.loads(ask("/legislation/No%20such%20Act/sections")[2]) == {"chunks": []}
    status, kind, body = ask("/legislation/Privacy%20Act%201988/text")
    assert status == 200 and kind.startswith("text/plain") and body == engine.act_text("Privacy Act 1988")


def test_a_request_over_a_socket(engine):
    with service.server(service.Service(engine), port=0) as it:
        threading.Thread(target=it.serve_forever, daemon=True).start()
        with urlopen(f"http://127.0.0.1:{it.server_port}/legislation/Bare%20Act%202000", timeout=60) as answer:
            got = json.load(answer)
        it.shutdown()
    # a document of record without a URI has no date and no year, and its counts all the same
    assert got["as_at_date"] == "" and got["section_count"] == 1 and got["schedule_clause_count"] == 0


def test_tool_calls(engine):
    calls = [
        {"id": 1, "method": "initialize", "params": {}},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "get_act_sections", "arguments": {"act_name": "Spam Act 2003"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "get_act_metadata", "arguments": {"act_name": "No such Act"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "search_legislation", "arguments": {}}},
        {"id": 6, "method": "tools/call", "params": {"name": "none"}},
        {"id": 7, "method": "none"},
    ]
    out = io.StringIO()
    service.speak(service.Service(engine), io.StringIO("\n".join(["{", "[]", *map(json.dumps, calls)])), out)
    answers = [json.loads(a) for a in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [None, None, 1, 2, 3, 4, 5, 6, 7]
    assert {t["name"] for t in answers[3]["result"]["tools"]} == set(service.TOOLS)
    assert json.loads(answers[4]["result"]["content"][0]["text"])["chunks"][0]["eid"] == "sec-1"
    assert answers[5]["result"]["isError"]
    assert [a["error"]["code"] for a in (*answers[:2], *answers[6:])] == [-32700, -32600, -32602, -32602, -32601]


def test_tools_need_a_store(monkeypatch):
    monkeypatch.delenv(service.STORAGE, raising=False)
    with pytest.raises(SystemExit, match=service.STORAGE):
        cli.main(["mcp"])


class Kinds:
    """Passages and queries lie apart but for their first component."""

    name, dim = "kinds", 3

    def embed(self, texts, kind):
        return [[1.0 + len(t) % 7, 1.0, 0.0] if kind == "passage" else [1.0, 0.0, 1.0] for t in texts]


def test_passages_and_queries_are_embedded_as_such(spark, monkeypatch):
    stored = embedding.embed_texts(spark.createDataFrame([("i", "abc")], "id string, text string"), Kinds())
    assert stored.first()["vector"] == [4.0, 1.0, 0.0]
    asked = []

    class One:
        def search_vector(self, query, k, keep=None, probes=None):
            asked.append(query)
            return spark.createDataFrame([("s", 1, 1, 0.5)], "segment string, doc long, tie long, score double")

        def fetch(self, hits):
            return hits

    monkeypatch.setattr(lexical, "query_terms", lambda spark, q: [])
    monkeypatch.setattr(index, "read", lambda spark, folder: One())
    assert Engine(spark, "none", Kinds())._hybrid("x", "abc", 1).count() == 1
    assert asked == [[1.0, 0.0, 1.0]]


def test_again_is_the_same(engine, corpus_dir):
    ids = lambda: sorted(r["id"] for r in index.read(engine.spark, f"{engine.storage}/legislation_section").payload.select("id").collect())
    before = ids()
    engine.ingest(corpus_dir, engine.cache)
    assert before and ids() == before


def test_shards_into_one_store_make_the_whole(spark, engine, corpus_dir, tmp_path):
    one = Engine(spark, str(tmp_path / "one"))
    counts = [one.ingest(corpus_dir, None, (i, 1)) for i in (0, 1, 1, 2)]
    assert sum(c["provisions"] for c in counts) - counts[2]["provisions"] == 7

    def tables(e):
        out = {}
        for name in (index.PROVISIONS, index.ACTS):
            c = index.read(spark, f"{e.storage}/{name}")
            parts = {"payload": c.payload.select("id", "document"), "vectors": c.vectors.select("id", "vector"), "df": c.term_stats(), "n": spark.createDataFrame([(c.n, c.manifest["length"])], "n long, length long")}
            out[name] = {k: sorted(map(repr, (tuple(sorted(r.asDict().items())) for r in df.collect()))) for k, df in parts.items()}
        return out

    assert tables(one) == tables(engine)
    # a change that fails half-way changes nothing
    with pytest.raises(Exception, match="no vectors"):
        broken = spark.range(1).selectExpr("'x' as act_name", "'i' as id", "'d' as document")
        index._segment(broken, f"{one.storage}/{index.ACTS}", lambda stored: stored.selectExpr("id", "assert_true(false, 'no vectors') as vector"), False, None, None)
    assert tables(one) == tables(engine)


def test_a_shard_that_fails_stops_no_other(spark, engine, corpus_dir, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    for f in os.listdir(corpus_dir):
        (folder / f).write_bytes(open(os.path.join(corpus_dir, f), "rb").read())
    good = (folder / "spam.xml").read_bytes()
    (folder / "spam.xml").write_text("<broken")
    e = Engine(spark, str(tmp_path / "s"))
    report = shards.ingest(e, str(folder), 1)
    assert (report["shards"], report["done"]) == (3, 2) and list(report["failed"]) == [1] and report["provisions"] == 6
    assert e.act_provisions("Spam Act 2003").count() == 0 and e.act_provisions("Bare Act 2000").count() == 2
    (folder / "spam.xml").write_bytes(good)
    done = []
    whole = e.ingest
    e.ingest = lambda corpus_dir, cache, shard: done.append(shard) or whole(corpus_dir, cache, shard)
    report = shards.ingest(e, str(folder), 1)
    assert done == [(1, 1)] and report["failed"] == {} and report["provisions"] == 7
    assert shards.ingest(e, str(folder), 1)["done"] == 3 and len(done) == 1
    ids = lambda x: {r["id"] for r in index.read(spark, f"{x.storage}/{index.PROVISIONS}").payload.select("id").collect()}
    assert ids(e) == ids(engine)


def test_the_parser_in_sql(spark):
    markup.register(spark)
    spark.createDataFrame([(1, bytearray(PRIVACY.encode())), (2, None)], "k int, content binary").createOrReplaceTempView("akn_files")
    rows = spark.sql("SELECT k, eid, text FROM akn_files, LATERAL akn_provisions(content) ORDER BY kind_ord, prov_ord").collect()
    assert [(r["k"], r["eid"]) for r in rows] == [(1, e) for e in ("sec-10", "sec-6", "sec-6__subsec-1", "schedule-1__clause-1")]


def test_shards_merge_to_the_whole(spark, engine, corpus_dir, tmp_path):
    for i in range(3):
        Engine(spark, str(tmp_path / f"s{i}")).ingest(corpus_dir, str(tmp_path / f"c{i}"), (i, 1))
    assert Engine(spark, str(tmp_path / "none")).ingest(corpus_dir, None, (9, 1))["provisions"] == 0
    whole = Engine(spark, str(tmp_path / "all"))
    shards = [str(tmp_path / f"s{i}") for i in range(3)]
    read = whole.merge(shards, [str(tmp_path / f"c{i}") for i in range(3)], str(tmp_path / "c"))
    assert read["legislation_section"] == 7
    query = lambda e: [(r["eid"], round(r["score"], 6)) for r in e.search_provisions("personal information", 5).orderBy("rank").collect()]
    assert query(whole) == query(engine)
    with pytest.raises(ValueError):
        whole.merge(shards, ["one"])


def test_cache_of_another_model_is_refused(spark, tmp_path):
    embedding.EmbedCache(spark, str(tmp_path / "c"), "model-a")
    embedding.EmbedCache(spark, str(tmp_path / "c"), "model-a")
    embedding.EmbedCache(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        embedding.EmbedCache(spark, str(tmp_path / "c"), "model-b")
    embedding.EmbedCache(spark, str(tmp_path / "d"), "model-b")
    with pytest.raises(ValueError):
        embedding.merge_caches(spark, [str(tmp_path / "c"), str(tmp_path / "d")], str(tmp_path / "e"))


def test_cache_embeds_each_text_once(spark, tmp_path):
    class Counting(embedding.HashingEmbedder):
        def embed(self, texts, kind):
            assert len(texts) == len(set(texts)) and "old" not in texts
            return super().embed(texts, kind)

    cache = embedding.EmbedCache(spark, str(tmp_path / "c"), "m")
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string").coalesce(1)
    cache.fill(texts("old"), embedding.HashingEmbedder())
    counts = embedding.hit_counts(embedding.lookup(texts("old", "new", "new"), cache.read())).first()
    assert (counts["hits"], counts["misses"]) == (1, 2)
    cache.fill(texts("old", "new", "new"), Counting())
    assert cache.read().count() == 2


def test_fusion_and_ties(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.8)], "id long, score double")
    b = spark.createDataFrame([(3, 5.0), (4, 4.0)], "id long, score double")
    got = [(r["id"], r["score"]) for r in fusion.fuse([a, b], 3).collect()]
    assert got == [(3, round(1 / 63 + 1 / 61, 6)), (1, round(1 / 61, 6)), (2, round(1 / 62, 6))]


def test_dense_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-2.0, 0.0])], "id long, vector array<float>")
    assert {r["id"]: r["score"] for r in dense.cosine_scores(v, [2.0, 0.0]).collect()} == {1: 1.0, 4: -1.0}
    assert dense.cosine_scores(v, [0.0, 0.0]).count() == 0
    with pytest.raises(Exception, match="dimension"):
        dense.cosine_scores(v, [1.0]).collect()


def test_codes_choose_and_vectors_score(spark):
    rows = [(f"i{i:03d}", [math.cos(i / 40), math.sin(i / 40), 0.001 * (i % 3)]) for i in range(200)] + [("null", None), ("tiny", [1e-9, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id string, vector array<double>").persist()
    codes = dense.quantise(vectors.where("vector is not null")).select("id", "code").persist()
    for q in ([1.0, 0.2, 0.0], [-1.0, 0.5, 0.1]):
        want = lexical.top(dense.cosine_scores(vectors.where("id <> 'tiny'"), q), 10, None).orderBy(F.desc("score"), "id").collect()
        assert lexical.top(dense.rescored(vectors, codes, q, 10), 10, None).orderBy(F.desc("score"), "id").collect() == want
    assert {r["id"] for r in dense.rescored(vectors, codes.where("id in ('tiny', 'i199')"), [1.0, 0.0, 0.0], 1).collect()} == {"tiny", "i199"}
    assert dense.rescored(vectors, codes, [0.0, 0.0, 0.0], 3).count() == 0
    with pytest.raises(Exception, match="dimension"):
        dense.rescored(vectors, codes, [1.0], 3).collect()


def test_a_quantised_store_answers_as_the_exact_one(spark, engine, tmp_path):
    coded = Engine(spark, str(tmp_path / "q"), quantised=True)
    coded.merge([engine.storage])
    assert index.read(spark, f"{coded.storage}/{index.PROVISIONS}").codes.count() == 7
    assert index.read(spark, f"{engine.storage}/{index.PROVISIONS}").codes is None
    ask = lambda e: [r.asDict() for r in e.search_provisions("personal information", 3, act="Privacy Act 1988").orderBy("rank").collect()]
    assert ask(coded) == ask(engine)


def test_index_and_texts_score_alike(spark):
    rows = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, None), (4, "cat cat cat")], "id long, text string")
    index = lexical.build(rows)
    score = lambda df: {r["id"]: round(r["score"], 9) for r in df.collect()}
    assert score(lexical.search_index(index, ["cat", "the"])) == score(lexical.search_texts(rows, ["cat", "the"]))


def test_render_rounds_as_python(spark):
    rows = spark.createDataFrame(
        [(1, 0.125, "A Act 1988", "/akn/au/act/1988/1", "sec-1", "1", "section", None, "Text", None), (2, 2.675, "A Act 1988", "/x@2020-01-01", "schedule-2__clause-3", "3", "schedule_clause", "Head", "More", ["#sec-1", "unresolved:Z", "/akn"])],
        "rank int, score double, act_name string, frbr_uri string, eid string, provision_num string, provision_type string, heading string, text string, refs array<string>",
    )
    assert render.text(rows) == "[A Act 1988 1988 s 1 (sec-1) score=0.12]\nText\n\n[A Act 1988  Sch 2 cl 3 (schedule-2__clause-3) score=2.67 (as at 2020-01-01)]\nHead\nMore\nRefs: #sec-1, /akn"
    assert render.text(rows.limit(0)) == render.NOTHING


def test_command_line(spark, corpus_dir, tmp_path, capsys):
    assert cli.main(["ingest", "--corpus-dir", corpus_dir, "--storage-dir", str(tmp_path / "s"), "--shard", "1/1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["acts"] == 1
    assert cli.main(["ingest-shard", "--corpus-dir", corpus_dir, "--storage-dir", str(tmp_path / "e"), "--shard-index", "9", "--shard-size", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["provisions"] == 0  # a shard beyond the last is empty
    assert cli.main(["search", "commercial messages", "--storage-dir", str(tmp_path / "s"), "--limit", "1"], spark) == 0
    assert capsys.readouterr().out.startswith("[Spam Act 2003 2003 s 1")
    assert cli.main(["merge", "--storage-dirs", str(tmp_path / "s"), "--output-storage-dir", str(tmp_path / "m")], spark) == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id long, text string").write.parquet(str(tmp_path / "in/x"))
    q = embed_stream(spark, str(tmp_path / "in/*"), "id long, text string", str(tmp_path / "out"), str(tmp_path / "cache"), str(tmp_path / "cp"), embedding.HashingEmbedder())
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("vector").isNotNull()).count() == 3
    assert embedding.EmbedCache(spark, str(tmp_path / "cache")).read().count() == 2


def test_versions_arrive_late_twice_and_in_any_order(spark, tmp_path):
    schema = "id string, version long, ts timestamp, act_name string, document string"
    at = lambda day: datetime(2024, 1, day)
    batches = [
        [("a", 1, at(1), "X", "a one"), ("b", 3, at(2), "X", "b three"), ("a", 1, at(1), "X", "a one")],
        [("b", 2, at(1), "X", "b two"), ("a", 2, at(3), "X", "a two"), ("c", 1, at(3), "Y", "c one")],
        [("a", 1, at(1), "X", "a one"), ("c", 2, at(4), "Y", "c two"), (None, 1, at(4), "Y", "none")],
        [("a", 9, datetime(2023, 1, 1), "X", "too late")],
    ]
    folder, dropped = str(tmp_path / "store"), 0
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"in/{i}"))
        q = upsert_stream(spark, str(tmp_path / "in/*"), schema, folder, str(tmp_path / "cp"), embedding.HashingEmbedder(), "30 days")
        assert q.awaitTermination(180)
        dropped += late_rows(q)
    kept = {r["id"]: (r["version"], r["document"]) for r in index.read(spark, folder).payload.collect()}
    assert kept == {"a": (2, "a two"), "b": (3, "b three"), "c": (2, "c two")} and dropped == 1
