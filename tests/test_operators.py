"""Files, streams, pages, rankings, graphs, metrics and decisions on small fixtures."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions import text
from annalist.operators import eligibility, evidence, graph, metrics, pages, pipeline, retrieval, scan, segmentation, versions
from annalist.sources import files, shared
from annalist.streaming import monitor
from helpers import rows


def test_json_and_text_sources(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
    assert files.read_json_array(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "status": "x"}, {"id": 2}]))
    assert rows(files.read_json_array(spark, str(tmp_path / "a.json"), schema)) == [(1, "x"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"id": 1, "status": "approved"}\n\n{"id": 2, "status": "draft"}\n{broken\n')
    assert files.read_json_lines(spark, str(tmp_path / "b.jsonl"), schema, "approved").count() == 1
    good, bad = files.read_checked(spark, str(tmp_path / "b.jsonl"), schema)
    assert good.count() == 2 and [r.value for r in bad.collect()] == ["{broken"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("line\nline")
    (tmp_path / "t" / "empty.txt").write_text("")
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "t")).collect()] == ["line\nline"]
    assert files.with_defaults(spark.createDataFrame([(1, "z")], "id int, other string"), schema, {"status": "new"}).collect() == [(1, "new")]


def test_versions_are_swapped_in_only_when_they_hold(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    files.swap_in(df.filter("v is not null"), folder, "one", {"no null": "v is null"})
    with pytest.raises(ValueError):
        files.swap_in(df, folder, "two", {"no null": "v is null"})
    assert rows(files.current(spark, folder)) == [(1, "a")]
    with pytest.raises(Exception):
        files.swap_in(df, folder, "one")


def test_manifest(spark):
    have = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    named = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("../e", "5"), ("a", "1")], "path string, sha256 string")
    assert rows(files.manifest_problems(have, named)) == [("../e", "unsafe path"), ("a", "named twice"), ("b", "checksum differs"), ("c", "not in the manifest"), ("d", "missing")]


def test_bounded_broadcast(spark):
    df = spark.range(10)
    assert rows(shared.bounded(df, 10)) == rows(df) == rows(shared.bounded(df, 3))
    assert shared.bounded(df, 3) is df


def test_stream_gives_the_batch_result(spark, tmp_path):
    r = random.Random(1)
    checks = [(f"p{r.randrange(6)}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, r.choice(["a", "b", "c", None])) for i in range(120)]
    src = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame(checks[i * 40 : i * 40 + 40], monitor.CHECK).coalesce(1).write.parquet(str(src / f"batch={i}"))
    stream = spark.readStream.schema(monitor.CHECK).option("maxFilesPerTrigger", 1).parquet(str(src / "batch=*"))
    q = monitor.updates(stream).writeStream.format("memory").queryName("updates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = rows(spark.table("updates").select("page", "change", "version_no", "seq"))
    seen_all = spark.createDataFrame(checks, monitor.CHECK).filter("content is not null")
    batch = versions.observed(seen_all, "page", [F.asc("seq")], "content").filter("change <> 'UNCHANGED'")
    batch_rows = rows(batch.select("page", "change", F.col("version_no").cast("int"), "seq"))
    assert batch_rows == got and len(got) > 10


def test_updates_are_written_and_announced_once(spark, tmp_path):
    """Also when a change comes again, a late check arrives, or a batch is run twice."""
    rows_of = lambda *x: spark.createDataFrame([(p, dt.datetime(2024, 1, 1), n, c) for p, n, c in x], monitor.CHECK)
    src, out, told = tmp_path / "in", str(tmp_path / "out"), []
    parts = [rows_of(("p", 1, "a"), ("p", 2, "b"), ("q", 3, None)), rows_of(("p", 4, "a"), ("p", 5, "b"), ("p", 0, "late")), rows_of(("q", 6, "x"))]
    for i, x in enumerate(parts):
        x.coalesce(1).write.parquet(str(src / f"batch={i}"))
    write = monitor.once(out, lambda df: told.extend(r.update_id for r in df.collect()))
    seen, progress = [], monitor.Progress()
    spark.streams.addListener(progress)

    def twice(batch, number):
        batch = spark.createDataFrame(batch.collect(), batch.schema)
        seen.append(batch.count())
        write(batch, number)
        write(batch, number)

    stream = spark.readStream.schema(monitor.CHECK).option("maxFilesPerTrigger", 1).parquet(str(src / "batch=*"))
    q = monitor.updates(stream).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.read.parquet(out)
    assert sum(seen) == 5 and got.count() == 4 == got.select("update_id").distinct().count() and sorted(told) == sorted(r.update_id for r in got.collect())
    spark.streams.removeListener(progress)
    assert progress.rows(spark).columns == ["name", "batch", "n_rows", "ms"]


def test_archives_backups_and_registries(spark, tmp_path):
    import gzip
    import hashlib
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("../b.txt", "two")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    got = files.read_zip(spark, str(tmp_path)).select("path", "sha256")
    assert {r.path for r in got.collect()} == {"a.txt", "../b.txt", None}
    named = spark.createDataFrame([("a.txt", hashlib.sha256(b"one").hexdigest()), ("../b.txt", hashlib.sha256(b"two").hexdigest())], "path string, sha256 string")
    assert rows(files.manifest_problems(got.filter("path is not null"), named)) == [("../b.txt", "unsafe path")]
    (tmp_path / "x.json.gz").write_bytes(gzip.compress(b'{"id": 1}\n{"id": 2}\n'))
    schema = T.StructType([T.StructField("id", T.LongType())])
    good = hashlib.sha256((tmp_path / "x.json.gz").read_bytes()).hexdigest()
    sums = lambda h: spark.createDataFrame([("x.json.gz", h)], "name string, sha256 string")
    assert files.read_backup(spark, str(tmp_path), schema, sums(good)).count() == 2
    with pytest.raises(ValueError):
        files.read_backup(spark, str(tmp_path), schema, sums("0"))
    ok, out = files.sorted_out(spark.createDataFrame([("a", "html"), ("b", "pdf"), ("c", None)], "path string, kind string"), "kind")
    assert ok.count() == 1 and rows(out, "path", "reason") == [("b", "unsupported type: pdf"), ("c", "unsupported type: none")]
    (tmp_path / "s.yaml").write_text("- {id: a, enabled: true}\n- {id: b, enabled: false}\n- {id: c}\n")
    assert rows(files.read_registry(spark, str(tmp_path / "s.yaml"), T.StructType([T.StructField("id", T.StringType())]))) == [("a",), ("c",)]


def test_graph_is_saved_whole_or_not(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b", "S")], "source string, target string, type string")
    files.save_graph(nodes, edges, str(tmp_path), "one")
    with pytest.raises(ValueError):
        files.save_graph(nodes.filter("id = 'a'"), edges, str(tmp_path), "two")
    n, e = files.load_graph(spark, str(tmp_path))
    assert n.count() == 2 and rows(e) == [("a", "b", "S")]


def test_database_tables(spark):
    """Scans, upserts and deletes against the embedded database that the engine brings."""
    url = "jdbc:derby:memory:annalist;create=true"
    files.execute_jdbc(spark, url, 'CREATE TABLE chunks ("k" INT PRIMARY KEY, "v" VARCHAR(20))')
    frame = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    files.write_jdbc(frame((1, "a"), (2, "b")), url, "chunks", customSchema="")
    files.upsert_jdbc(frame((2, "x"), (3, "y")), url, "chunks", "k", "staged")
    assert rows(files.read_jdbc(spark, url, 'SELECT "k", "v" FROM chunks')) == [(1, "a"), (2, "x"), (3, "y")]
    files.upsert_jdbc(frame((2, "x"), (3, "y")), url, "chunks", "k", "staged")
    files.delete_jdbc(frame((1, None), (9, None)), url, "chunks", "k", "gone")
    assert rows(files.read_jdbc(spark, url, "chunks", partitionColumn="k", lowerBound="0", upperBound="9", numPartitions="2")) == [(2, "x"), (3, "y")]


PAGE = """<html><head><style>p {}</style></head><body><nav>Menu</nav><div id="content"><h1>Title</h1><p>Kept <s>old</s><span style="text-decoration: line-through">gone</span> text &amp; more<br>next</p>
<table><tr><td>a</td><td>b</td></tr></table><script>x()</script></div><footer>Foot</footer></body></html>"""


def test_page_text(spark):
    assert pages.html_text(PAGE) == "Title\nKept text & more\nnext\na\nb"
    assert pages.html_text("<nav>x</nav><p>only</p>") == "only" and pages.html_text("") == "" and pages.html_text(None) is None
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    assert [r.text for r in pages.pages_to_text(df, "page_id", "html").orderBy("page_id").collect()][1] is None


def test_units_follow_their_numbers():
    doc = "Heading\nChapter I - General\n1. First [^1]\n7. not a paragraph\n2. Second\nmore\n[^1] amended in 2020\nAnnex A\n1. Again\n\n"
    assert segmentation.units(doc) == [
        ("text", (), ["Heading"]), ("1", ("Chapter I - General",), ["1. First [^1]", "7. not a paragraph", "[^1] amended in 2020"]),
        ("2", ("Chapter I - General",), ["2. Second", "more"]), ("1", ("Annex A",), ["1. Again"]),
    ]
    assert segmentation.units("") == []


def test_windows_end_with_the_text(spark):
    df = spark.createDataFrame([("d", 1, " ".join(map(str, range(n)))) for n in (0, 1, 10, 11, 25)] + [("d", 1, None)], "document_id string, page_number int, text string")
    got = segmentation.window_chunks(df, 10, 4)
    by = {}
    for r in got.collect():
        by.setdefault(r.text.split()[-1], []).append(r)
    sizes = sorted((r.chunk_index, len(r.text.split())) for r in got.collect())
    assert sizes == sorted([(0, 1), (0, 10), (0, 10), (1, 5), (0, 10), (1, 10), (2, 10), (3, 7)])
    with pytest.raises(ValueError):
        segmentation.windows(F.col("text"), 4, 4)


def test_references_and_dates(spark):
    t = "Under CCA/2024-2025/12 and DCR.POL.No.66 / 13.07.005/2021-22 of May 8, 2025; see paragraphs 5, 6 and 7 and paragraph 9 of the Master Code."
    df = spark.createDataFrame([("c", "d", t), ("n", "d", None), ("e", "d", "")], "chunk_id string, document_id string, text string")
    assert df.select(segmentation.references(F.col("text")).alias("r")).first().r == ["DCR.POL.66/13.07.005/2021-22", "CCA/2024-25/12"]
    assert [r.label for r in segmentation.paragraph_references(df).orderBy("place").collect()] == ["5", "6", "7"]
    days = spark.createDataFrame([("on May 8, 2025",), ("24.06.2020 or 01/02/2021",), ("31.02.2020",), ("",), (None,)], "t string").select(text.parse_date(F.col("t")).alias("d"))
    assert [r.d for r in days.collect()] == [dt.date(2025, 5, 8), dt.date(2020, 6, 24), None, None, None]


def test_bm25_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(f"d{i:03d}", " ".join(r.choices(vocabulary, k=r.randrange(1, 30))), None if i % 3 else dt.date(2024, 1, 1 + i % 20), dt.date(2024, 1, 15) if i % 4 == 0 else None) for i in range(90)] + [("e", "", None, None), ("n", None, None, None)]
    queries = [(i, " ".join(r.choices(vocabulary, k=4)), dt.date(2024, 1, 5 + i)) for i in range(12)] + [(50, "unknown words", dt.date(2024, 1, 1)), (51, None, dt.date(2024, 1, 1)), (52, "", dt.date(2024, 1, 1))]
    d = spark.createDataFrame(docs, "id string, text string, a date, b date")
    q = spark.createDataFrame(queries, "query_id long, query string, day date")
    texts = [(k, t.split(), a, b) for k, t, a, b in docs if t is not None]
    avg = sum(len(t) for _, t, *_ in texts) / len(texts)
    index = scan.TextIndex.build(d, "id", "text", keep=["a", "b"])
    for window in (None, ("a", "b")):
        want = []
        for i, s, day in queries:
            scores = {}
            for w in set((s or "").split()):
                df = sum(w in t for _, t, *_ in texts)
                for k, t, a, b in texts:
                    tf = t.count(w)
                    if tf and (window is None or (a is None or a <= day) and (b is None or day < b)):
                        scores[k] = scores.get(k, 0) + np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
            want += [(i, k, n) for n, k in enumerate(sorted(scores, key=lambda k: (-round(scores[k], 6), k))[:7], 1)]
        assert rows(scan.bm25_top_k(index, q, 7, window).select("query_id", "id", "rank")) == sorted(want, key=repr)
    assert scan.bm25_top_k(index, q.limit(0), 3).count() == 0 and scan.bm25_top_k(scan.TextIndex.build(d.limit(0), "id", "text"), q, 3).count() == 0


def test_dense_and_blended_edges(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None)], "id long, v array<float>")
    q = v.filter("id = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    assert rows(scan.dense_top_k(v, "id", "v", q, 5)) == [(0, 1, 0.0, 2), (0, 2, 1.0, 1)]
    d = spark.createDataFrame([("a", "gold loan limits", "Gold"), ("b", None, None), ("c", "other words", "Gold loan")], "id string, t string, h string")
    got = scan.blended_top_k(scan.TextIndex.build(d, "id", "t", "h"), spark.createDataFrame([(1, "What are gold loan limits"), (2, "  ")], "query_id long, query string"), 5)
    assert [(r.query_id, r.id) for r in got.orderBy("rank").collect()] == [(1, "a"), (1, "c")]


def test_fusion_and_expansion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "x", 2), (1, "y", 3)], "query_id int, id string, rank int")
    assert retrieval.rrf([a, b], "id").filter("rank = 1").first().id == "x"
    cites = spark.createDataFrame([("x", "z", 0), ("x", "y", 1)], "id string, target string, place int")
    assert [r.id for r in retrieval.expand(a, "id", cites, head=1).orderBy("rank").collect()] == ["x", "z", "y"]
    assert [r.id for r in retrieval.expand(a, "id", cites.limit(0), head=1).orderBy("rank").collect()] == ["x", "y", "z"]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "S"), ("b", "c", "S"), ("c", "d", "S"), ("x", "y", "A"), ("x", "y", "A"), ("p", "q", "S"), ("q", "p", "S"), (None, "z", "S")], "source string, target string, type string")
    assert dict(rows(graph.degrees(e)))["x"] == 2
    assert rows(graph.chain_ends(e)) == [("a", "d", 3), ("b", "d", 2), ("c", "d", 1), ("x", "y", 1)]
    assert dict(rows(graph.components(e))) == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "p": "p", "q": "p"}
    starts = spark.createDataFrame([(1, "b")], "query_id int, id string")
    assert rows(graph.neighbours(e, starts, ["S"])) == [(1, "c")] and rows(graph.neighbours(e, starts, ["S"], reverse=True)) == [(1, "a")]
    long = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)], "source string, target string")
    assert rows(graph.chain_ends(long))[0] == ("n000", "n150", 150)


def test_eligibility(spark):
    day, today = dt.date(2024, 5, 1), dt.date(2024, 6, 1)
    data = [
        ("open", None, None, "ACTIVE", True, None, None), ("ended", None, dt.date(2024, 5, 1), "ACTIVE", True, True, None), ("later", dt.date(2024, 5, 2), None, "ACTIVE", True, True, None),
        ("unsettled", None, None, " unknown", False, True, None), ("gone", None, None, "WITHDRAWN", False, False, dt.datetime(2024, 5, 1, 12)), ("since", None, None, "WITHDRAWN", False, False, dt.datetime(2024, 5, 2)), ("null", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, "id string, in_force_from date, in_force_to date, lifecycle string, authority_current boolean, is_current boolean, valid_to timestamp")
    names = lambda c: {r.id for r in df.filter(c).collect()}
    assert names(eligibility.is_current_guidance(day, today)) == {"open", "since", "null"}
    assert names(eligibility.is_current_guidance(day, day)) == {"open"}
    assert names(eligibility.is_upcoming(day)) == {"later"}
    assert {r.id: r.w for r in df.select("id", eligibility.why_excluded(day).alias("w")).collect()}["gone"] == "older version"


def test_metrics(spark):
    v = spark.createDataFrame([(float(x),) for x in range(1, 21)], "x double")
    q = metrics.quantiles(v.withColumn("g", F.lit(1)), "g", "x").select(F.col("exclusive").alias("a"), F.col("nearest").alias("b"), F.col("upper_median").alias("c")).first()
    assert (round(q.a, 6), q.b, q.c) == (19.95, 20.0, 11.0)
    b = metrics.bootstrap_mean(v, "x", ["x"], 400).first()
    assert b.low < 10.5 < b.high and abs(b["mean"] - 10.5) < 0.3
    hits = spark.createDataFrame([(1, "g", 2), (1, "g", 1), (1, "h", 12)], "query_id int, gold string, rank int")
    assert metrics.ndcg(hits, spark.createDataFrame([(1, 1), (2, 1)], "query_id int, n_gold int")).orderBy("query_id").collect() == [(1, 1.0), (2, 0.0)]
    a = spark.createDataFrame([("k2", "v"), ("k1", "v"), ("k3", None)], "k string, v string")
    assert metrics.fingerprint(a, "k", "v").first() == metrics.fingerprint(a.orderBy("k"), "k", "v").first() != metrics.fingerprint(a.limit(2), "k", "v").first()


@pytest.mark.parametrize("whole", [10_000, 0])
def test_values_at_ranks(spark, monkeypatch, whole):
    """With groups ordered whole, and with bounds from approximate percentiles; ties, one value, nulls."""
    import statistics

    monkeypatch.setattr(metrics, "WHOLE", whole)
    r = random.Random(3)
    groups = {"many": [r.gauss(0, 1) for _ in range(4000)], "ties": [float(r.randrange(5)) for _ in range(3000)], **({"few": [3.0, 1.0, 2.0], "one": [7.0]} if whole else {})}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in [*xs, None]], "g string, v double")
    got = {x.g: x for x in metrics.quantiles(df, "g", "v").collect()}
    for g, xs in groups.items():
        xs = sorted(xs)
        n = len(xs)
        assert (got[g].n, got[g].nearest, got[g].upper_median) == (n, xs[min(int(0.95 * n), n - 1)], xs[n // 2])
        assert got[g].exclusive is None if n == 1 else n < 4 or abs(got[g].exclusive - statistics.quantiles(xs, n=20)[18]) < 1e-9


@pytest.mark.parametrize("largest", [False, True])
def test_best_of_batches_is_the_best_of_all(largest):
    """Ties by key, scores that round to nothing, queries with few results; what waits stays bounded, and k rows per query are left."""
    r = np.random.default_rng(5)
    score = np.round(r.random((6000, 7)) ** 3, 2) + r.choice([0, 3e-7], (6000, 7))
    score[:, 5], score[:, 6] = 0, np.where(np.arange(6000) % 2000 == 7, 0.5, 4e-7)
    keys = np.array([f"k{x:05d}" for x in r.permutation(6000)], object)
    best, k = scan.Best(7, 20, 6, largest), 20
    for at in range(0, 6000, 500):
        best.add(score[at : at + 500], keys[at : at + 500])
        assert best.waiting < k * 7
    got = {}
    for q, key, x in zip(*best.found()):
        got.setdefault(q, []).append((key, x))
    for q in range(7):
        every = sorted(zip(keys, np.round(score[:, q], 6)), key=lambda x: x[0], reverse=largest)
        assert got.get(q, []) == sorted([x for x in every if x[1] > 0], key=lambda x: -x[1])[:k]
    assert 5 not in got and len(got[6]) == 3


def test_words_beyond_the_dense_product_count_alike(spark):
    texts = [(f"c{i:05d}", f"w{i % 7} w{i % 11} w{i % 600} common") for i in range(5000)]
    index = scan.TextIndex.build(spark.createDataFrame(texts, "id string, text string").coalesce(1), "id", "text")
    q = spark.createDataFrame([(i, f"w{i} common") for i in range(600)], "query_id long, query string")
    got = scan.bm25_top_k(index, q, 3)
    taken = {tuple(x) for x in got.select("query_id", "id", "rank").collect()}
    n, words = len(texts), [set(t.split()) for _, t in texts]
    df = {w: sum(w in x for x in words) for w in {f"w{i}" for i in range(600)} | {"common"}}
    size = [len(t.split()) for _, t in texts]
    for i in (0, 3, 10, 300, 599):
        value = lambda w, t, m: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * m / np.mean(size)))
        order = sorted((-round(sum(value(w, t.split(), m) for w in (f"w{i}", "common")), 6), c) for (c, t), m in zip(texts, size))[:3]
        assert {(i, c, k + 1) for k, (_, c) in enumerate(order)} == {x for x in taken if x[0] == i}
    assert len(taken) == 1800


def test_rankings_are_made_once_and_texts_stay(spark, monkeypatch):
    """What the composed retrieval writes: each ranking once, no texts."""
    kept = {}
    monkeypatch.setattr(pipeline, "materialize", lambda df, what: kept.setdefault(what, shared.materialize(df, what)))
    p = spark.createDataFrame([("a", "gold loan", True), ("b", "gold", False), ("c", "loan", True)], "k string, text string, holds boolean")
    q = spark.createDataFrame([(1, "gold loan"), (2, "none")], "query_id long, query string")
    rank = lambda *ks: spark.createDataFrame([(1, k, n + 1) for n, k in enumerate(ks)], "query_id long, k string, rank int")
    got = pipeline.retrieve(q, p, "k", "text", rank("c", "b"), rank("b", "a"), None, F.col("holds"), None, pipeline.overlap_reranker)
    assert rows(got.results.select("query_id", "k", "rank")) == [(1, "a", 1), (1, "c", 2)]
    assert {"lexical", "dense", "fused", "judged", "reranked"} == set(kept) and "text" not in kept["judged"].columns


def test_heads_meet_the_first_passage_that_holds_them(spark):
    r = random.Random(9)
    text = lambda n: "".join(r.choices("abc de", k=n)).strip() or "x"
    base = [text(200) for _ in range(12)]
    data = [(f"c{i:02d}", f"d{i % 2}", i, (base[r.randrange(12)][r.randrange(80):] + text(40))[: r.choice([59, 60, 61, 200])]) for i in range(60)] + [("n", None, 1, base[0]), ("s", "d0", 99, None)]
    df = spark.createDataFrame(data, "chunk_id string, document_id string, chunk_index int, t string")
    want = {(c, min((j, k) for k, e, j, u in data if e == d and u and t[:60] in u)[1]) for c, d, i, t in data if d and t and len(t) >= 60}
    assert {tuple(x) for x in evidence.first_with_head(df).collect()} == want and any(a != b for a, b in want)


def test_heads_are_found_without_moving_texts(spark):
    """Long passages send out little more than the heads they hold; one longer than is looked at at once, and heads across its parts."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäß語😀", k=r.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(r.choices(words, k=600)) for _ in range(200)]
    vast = " ".join(r.choices(words, k=120_000))
    assert len(vast) > 2 * evidence.STRETCH
    cuts = [evidence.STRETCH - k for k in (100, 60, 59, 30, 1)] + [0, len(vast) - 60]
    data = [(f"c{i:03d}", f"d{i % 9}", i, t) for i, t in enumerate(texts)] + [("vast", "v", 0, vast)] + [(f"v{k}", "v", k + 1, vast[at : at + 60]) for k, at in enumerate(cuts)]
    df = spark.createDataFrame([(*x[:2], x[2] if x[0] != "c000" else None, x[3]) for x in data], "chunk_id string, document_id string, chunk_index int, t string")
    sent = evidence.held_heads(df).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("head")).alias("most")).first()
    assert len(data) <= sent.n < 5 * len(data) + 2000 and sent.most == evidence.HEAD
    assert {tuple(x) for x in evidence.first_with_head(df).collect()} == {(c, "vast" if d == "v" else c) for c, d, _, _ in data}


def test_decisions(spark):
    c = "relation string, scope string, method string, evidence_quote string, n_matched int, new_url string, old_url string, new_day date, old_day date, new_status string, new_id string, old_id string"
    good = ("SUPERSEDES", "WHOLE", "repeal_annex", "q", 1, "https://www.gov.example/a", "https://gov.example/b", dt.date(2024, 1, 2), dt.date(2024, 1, 1), "ACTIVE", "n", "o")
    bad = ("AMENDS", None, "guess", " ", 2, "https://notgov.example/a", None, None, dt.date(2024, 1, 1), "REPEALED", "o", "o")
    got = [r.why for r in spark.createDataFrame([good, bad], c).select(versions.trust_reasons("gov.example").alias("why")).collect()]
    assert got[0] == [] and len(got[1]) == 9 and "not dated" in got[1]
    end = spark.createDataFrame([(None, dt.date(2024, 2, 1)), (dt.date(2024, 1, 1), dt.date(2024, 2, 1)), (None, dt.date(2025, 1, 1))], "e date, s date").select(versions.switch_over(F.col("e"), F.col("s"), F.lit(dt.date(2024, 6, 1))).alias("x"))
    assert [r.x for r in end.collect()] == [dt.date(2024, 2, 1), dt.date(2024, 1, 1), None]
    d = spark.createDataFrame([("Rate 5 %\nold line", "Rate 6 %\n old line \nnew on May 8, 2024")], "a string, b string").select(versions.diff(F.col("a"), F.col("b")).alias("d")).first().d
    assert d.added == ["Rate 6 %", "new on May 8, 2024"] and d.removed == ["Rate 5 %"] and d.changed_dates == ["May 8, 2024"]
    v = spark.createDataFrame([("supported", 1, "A  b", "x a b y"), ("supported", 1, "zz", "x"), (None, 1, "x", "x"), ("supported", 0, "x", "x")], "v string, n int, q string, t string")
    assert [r.x for r in v.select(evidence.verdict(F.col("v"), F.col("n"), F.col("q"), F.col("t")).alias("x")).collect()] == ["supported", "partially_supported", "not_supported", "not_supported"]


def test_upserts_are_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, v string")
    once = versions.insert_if_absent(new, old, "k")
    assert rows(once) == [(1, "a"), (2, "b"), (3, "y")] == rows(versions.insert_if_absent(new, once, "k"))
    assert rows(versions.upsert(new.distinct(), old, "k")) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(versions.delete(old, new, "k")) == [(1, "a")]


def test_pages_that_are_badly_written():
    t = pages.html_text
    assert t("<p>a<p>b<br/>c</div>d") == "a\nb\nc d".replace("c d", "cd") and t("<!-- x <p> -->a<!DOCTYPE html>b") == "ab" and t("a<script>if (1<2) x()") == "a"
    assert t("<DIV ID='Content'>in</DIV>out") == "in" and t("<p title='a > b'>x</p>") == "x" and t("<p>" * 5000 + "deep") == "deep"


def test_listed_links(spark):
    page = "<a href='/n/1'>Old  title</a><a class=x href=\"b.html\">Loan <b>rules</b></a><a href='#top'>Top</a><a href='/n/1'>New loan title</a><a href='https://else.example/c'></a><a href='mailto:a@b.c'>Mail loans</a>"
    df = spark.createDataFrame([("s", page, "https://a.example/list/index.html"), ("n", None, None)], "id string, html string, base string")
    want = [("s", "https://a.example/list/b.html", "Loan rules", 1), ("s", "https://a.example/n/1", "New loan title", 0)]
    assert rows(pages.listed_links(df, "id", "html", "base")) == want
    assert rows(pages.listed_links(df, "id", "html", "base", ["new"])) == [("s", "https://a.example/n/1", "New loan title", 0)]
    kinds = spark.createDataFrame([("application/pdf", "x.html"), (None, "https://a/b.HTML?x=1"), (None, "https://a/b"), ("text/plain", None)], "h string, u string")
    assert [r.k for r in kinds.select(pages.media_type(F.col("h"), F.col("u")).alias("k")).collect()] == ["pdf", "html", "pdf", "text"]


def test_contents_tables_and_long_lines():
    toc = "Contents\nChapter I General\n1. Scope\n2. Limits .... 3\nChapter I General\n1. Scope\nBody one\n2. Limits\nBody two"
    u = segmentation.units(toc)
    assert [x[0] for x in u] == ["contents", "1", "2"] and u[0][2][-1] == "2. Limits .... 3" and u[1][2] == ["1. Scope", "Body one"]
    assert segmentation.contents_range(["Contents", "only once", "twice"]) == range(0)
    table = ["List of limits", "1", "Loans", "5%", "2", "Cards", "7%"]
    assert segmentation.table_runs(["A long line of prose that goes on well beyond the width of any cell."] + table[1:]) == [(1, 7)]
    parts = segmentation.blocks(["intro words here", *table], 6)
    assert all(segmentation.count_words("\n".join(p)) <= 6 for p in parts) and sum("List of limits" in p for p in parts) > 1
    one = "w " * 1500
    for name, cut in segmentation.CHUNKERS.items():
        got = cut(one)
        assert all(segmentation.count_words(t) <= 600 for _, _, t in got) or name == "recursive"
        assert cut("") == []
    got = segmentation.structure("1. " + "alpha " * 700 + "\n2. Short\n3. Short too")
    assert [x[0] for x in got] == ["1 (part1)", "1 (part2)", "2–3"]
    assert [len(t.split()) for _, _, t in segmentation.fixed("x " * 1000)] == [500, 500, 100]


def test_page_lines(spark):
    df = spark.createDataFrame([("d", 1, " 12 \nfirst  \n\nsecond"), ("d", 2, "7 days\n8"), ("d", 3, None), ("d", 4, "")], "id string, page int, text string")
    assert rows(segmentation.page_lines(df, "id", "page", "text")) == [("d", 1, 0, "first"), ("d", 1, 1, "second"), ("d", 2, 0, "7 days"), ("d", 2, 1, "8")]


def test_extensions_are_replaceable(spark):
    from annalist.operators import extensions as X

    df = spark.createDataFrame([("c", "Rules", "The Bank of x shall pay. A bank may. NBFC must report!"), ("n", "Rules", None), ("e", "Rules", "")], "chunk_id string, title string, text string")
    got = X.extension("extractor", "words")(df, ["Bank of x"])
    assert sorted((r.type, r.target) for r in got.collect()) == sorted([("ISSUED_BY", "Bank of x"), ("REQUIRES", "The Bank of x shall pay."), ("REQUIRES", "NBFC must report!")] + [("APPLIES_TO", "Banks"), ("APPLIES_TO", "NBFC")] * 2)
    for name in ("md5", "blake2b"):
        v = [r.v for r in df.select(X.extension("embedder", name)(F.col("text")).alias("v")).collect()]
        assert len(v[0]) == 384 and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and v[2] is None
    X.register("reranker", "none", lambda c: c.withColumn("score", F.lit(0.0)))
    assert X.extension("reranker", "none") is X.REGISTRIES["reranker"].pop("none")
    with pytest.raises(ValueError):
        X.extension("chunker", "unknown")
    with pytest.raises(TypeError):
        X.register("store", "x", None)
    ran = {r.step: r for r in X.run_steps(spark, {"a": lambda: df, "b": lambda: df.select("nothing"), "c": lambda: df.limit(1)}).collect()}
    assert (ran["a"].n, ran["b"].status, ran["c"].n) == (3, "failed", 1) and ran["b"].error


def test_pipeline_goes_on_without_parts(spark):
    from annalist.operators import pipeline

    q = spark.createDataFrame([(1, "gold loan"), (2, "nothing")], "query_id long, query string")
    p = spark.createDataFrame([("a", "gold loan limits", True), ("b", "gold", False), ("c", "loan gold", True)], "id string, text string, ok boolean")
    lexical = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 3)], "query_id long, id string, rank int")
    bare = pipeline.retrieve(q, p, "id", "text", lexical, k=2)
    assert rows(bare.results) == [(1, "a", 2, 0.5), (1, "b", 1, 1.0)]
    s = {(r.query_id, r.stage): (r.status, r.n) for r in bare.stages.collect()}
    assert s[1, "lexical"] == ("done", 3) and s[1, "dense"] == ("skipped", 0) and s[2, "cut"] == ("done", 0) and len(s) == 14
    full = pipeline.retrieve(q, p, "id", "text", lexical, lexical, None, F.col("ok"), F.lit("ended"), pipeline.overlap_reranker, k=1, candidates=2)
    assert rows(full.removed) == [(1, "b", "ended")] and rows(full.results, "id") == [("a",)]
    assert rows(full.reranked, "id", "before", "rank") == [("a", 1, 1), ("c", 2, 2)]
    assert rows(pipeline.grounded(q, full.reranked), "query_id", "status") == [(1, "grounded"), (2, "out_of_scope")]
    assert pipeline.retrieve(q.limit(0), p.limit(0), "id", "text", lexical.limit(0), rerank=pipeline.overlap_reranker).results.count() == 0


def test_unions_repeat_no_rows(spark, data):
    """The engine's own partitioning of unions is off once a table was read (it repeated rows of this query)."""
    from annalist.plans import ranking

    got = rows(ranking.g20_induced_evidence(spark, data), "query_id", "link_id")
    assert len(got) == len(set(got)) and spark.conf.get(shared.UNIONS) == "false"
