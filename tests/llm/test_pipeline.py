"""The pipeline against a plain version, stage by stage, and its registration."""

import hashlib
import random
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseworks.llm import queries
from tests.llm.test_operators import plain_components, plain_measures, plain_targets, tokenizer


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("the river of stone and winter house over bright".split()) + str(r.randrange(50)) for _ in range(n))


#: Twenty words and more in a language that no sample is of.
FOREIGN = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
    "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä esitettyihin oikeuksiin."
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, prose(40, i), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[5][1], "en", "s1", 0), (101, rows[5][1] + " more", "en", "s2", 0), (102, "too short", "en", "s0", 0), (103, None, "en", "s0", 0), (104, "1 2 3 " * 10, None, None, 0), (105, " ".join(map(str, range(40))), None, "s1", 0), (106, FOREIGN, None, "s2", 0)]
    d = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.collect()})
    clean = set(range(60))
    assert seen[0] == clean | {100, 101, 105, 106}
    assert seen[1] == clean | {100, 101}
    assert seen[2] == clean
    assert seen[3] <= clean and len(seen[3]) > 30
    out = P.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} == seen[3]
    mixed = Counter(r["doc_id"] for r in docs.collect())
    assert Counter(r["doc_id"] for r in out.collect()) == mixed and max(mixed.values()) <= 3


def test_an_empty_table_goes_through(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_documents_without_any_label_stay(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    out = P.language_id(spark, docs, folder)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == set(range(60)) | {100, 101, 102, 106}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} <= set(range(60)) | {106}
    assert P.run(spark, str(tmp_path)).count() > 30


def test_columns_of_any_name_pass_through(spark, folder, tmp_path):
    names = ["score", "lang_pred", "text_key", "of_doc_id", "row_id", "size", "copies", "keep_text", "part", "root", "rows", "stays", "host", "n_tokens", "ids"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.select(*names).distinct().collect() == [tuple(range(len(names)))]
    assert P.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_names_with_dots_and_ticks_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("x`y", F.lit(2)).withColumn("text.doc_id", F.lit(3))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {tuple(r)[-3:] for r in out.collect()} == {(1, 2, 3)}


def plain_kept(rows):
    """Ids that quality, language and one of each near duplicate leave, in plain Python; rows are (id, text, source)."""
    measured = [plain_measures(t) for _, t, _ in rows]
    failed = [m[0] < 20 or 100 * m[4] > 30 * m[0] for m in measured]
    n, f = Counter(s for *_, s in rows), Counter(s for (*_, s), bad in zip(rows, failed, strict=True) if bad)
    mean = sum(failed) / len(rows)
    between = sum(n[s] * (f[s] / n[s] - mean) ** 2 for s in n) / len(rows) - mean * (1 - mean) * (len(n) - 1) / len(rows)
    size = min(max(mean * (1 - mean) / between - 1, 1), 1e6) if between > 0 else 1e6
    good = [r for r, bad in zip(rows, failed, strict=True) if not bad and (f[r[2]] + mean * size) / (n[r[2]] + size) <= 0.5]
    told = [r for r in good if any(c.isalpha() for c in r[1]) and r[1] != FOREIGN]
    least = plain_components([i for i, *_ in told], [t for _, t, _ in told])
    return {i for i, *_ in good}, {i for i, *_ in told}, {i for i, _, c in least if i == c}


def test_stages_equal_a_plain_pipeline(spark, tmp_path):
    r, rows = random.Random(9), []
    for i in range(160):
        text = r.choice(rows)[1] if rows and r.random() < 0.2 else prose(r.choice([5, 25, 40, 90]), i)
        if text and r.random() < 0.3:
            text = " ".join([*text.split(), f"more{i}"])
        rows.append((i * 7 % 1000, " ".join(map(str, range(30))) if r.random() < 0.05 else text, r.choice(["a", "b", "c", None])))
    rows += [(2000 + i, prose(3 if i % 4 else 40, i), "poor") for i in range(40)] + [(3000, prose(9, 1) + " " + prose(9, 1) + " " + prose(9, 1), "a"), (4000, FOREIGN, "a")]
    docs = spark.createDataFrame([(i, t, None if t == FOREIGN else "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, want = docs, plain_kept(rows)
    for (_, stage), ids in zip(P.STAGES, want, strict=False):
        now = stage(spark, now, str(tmp_path))
        assert {x["doc_id"] for x in now.collect()} == ids
    assert 4000 in want[0] and 4000 not in want[1]
    assert any(i < 2000 for i in want[0]) and not any(2000 <= i < 3000 for i in want[0])
    left = [x for x in rows if x[0] in want[2]]
    sizes = Counter()
    for _, t, s in left:
        sizes[s] += len(t.split())
    of = {i: (t, s) for i, t, s in left}
    out, taken = P.run(spark, str(tmp_path)).collect(), Counter()
    tok = tokenizer()
    for x in out:
        text, source = of[x["doc_id"]]
        taken[source] += len(text.split())
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert max(Counter(x["doc_id"] for x in out).values()) <= 3
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= 91


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in queries.QUERIES} - {"pipeline"} == {f"op{i}" for i in range(1, 14)}
