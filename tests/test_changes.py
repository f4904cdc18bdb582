"""Snapshots, references, histories, attributes in time: edge cases, hot keys, and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from annalist.functions.urls import page_key
from annalist.operators import asof, history, orphans, skew, snapshots
from helpers import rows

DAY = [dt.date(2025, 1, 6) + dt.timedelta(7 * i) for i in range(6)]
SNAP = "snapshot_date date, source_id string, canonical_url string, normalized_text_hash string, metadata_hash string, delivered_at timestamp, url_key int, day string, old_day int"


def snap(spark, data):
    return spark.createDataFrame([(*r, dt.datetime(2025, 1, 6, 1), 1, "x", 2) if len(r) == 5 else (*r, 1, "x", 2) for r in data], SNAP)


def changes(spark, data, **kw):
    return {(r.url_key, DAY[0].toordinal() and (dt.date(1970, 1, 1) + dt.timedelta(r.day)).isoformat(), r.change_kind) for r in snapshots.snapshot_changes(snap(spark, data), **kw).collect()}


def test_page_key(spark):
    urls = {
        "HTTPS://www.A.example/Path/Sub//#frag": "a.example/path/sub",
        "https://a.example/x?b=2&a=1&utm_source=z": "a.example/x?a=1&b=2",
        "https://a.example/x/?utm_medium=mail": "a.example/x",
        "a.example": "a.example",
        "": "",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.k for r in df.select("u", page_key(F.col("u")).alias("k")).collect()} == urls


def test_snapshot_kinds_gaps_and_unknown_texts(spark):
    u = "https://a.example/p"
    data = [
        (DAY[0], "s", u + "1", "t1", "m", ), (DAY[0], "s", u + "2", "t2", "m"), (DAY[0], "s", u + "3", None, "m"),
        (DAY[1], "s", u + "1", None, "m"), (DAY[1], "s", u + "2", "t2x", "m"), (DAY[1], "s", u + "3", "t3", "m"),
        # the source delivers nothing at DAY[2]; another does
        (DAY[2], "z", "https://z.example/", "t", "m"),
        (DAY[3], "s", u + "1", "t1", "m2"), (DAY[3], "s", u + "3", None, "m"), (DAY[3], "s", u + "4", "t4", "m"),
        (DAY[4], "s", u + "2", "t2x", "m"), (DAY[4], "s", u + "1", "t1", "m2"), (DAY[4], "s", u + "3", "t3", "m"), (DAY[4], "s", u + "4", "t4", "m"),
        (None, "s", u + "9", "t", "m"), (DAY[4], None, u + "9", "t", "m"), (DAY[4], "s", None, "t", "m"),
    ]
    k = "a.example/p"
    want = {
        (k + "2", "2025-01-13", "changed"), (k + "3", "2025-01-13", "changed"),
        (k + "1", "2025-01-27", "changed"), (k + "2", "2025-01-27", "removed"), (k + "4", "2025-01-27", "added"), (k + "2", "2025-02-03", "added"),
    }
    assert changes(spark, data + data) == want
    assert changes(spark, data, buckets=1) == want


def test_last_delivery_counts_and_empty(spark):
    at = lambda h: dt.datetime(2025, 1, 13, h)
    data = [(DAY[0], "s", "https://a.example/1", "t", "m", at(1)), (DAY[1], "s", "https://A.example/1/", "new", "m", at(2)), (DAY[1], "s", "https://www.a.example/1", "t", "m", at(3))]
    assert changes(spark, data) == set()
    assert changes(spark, []) == set()


def test_snapshots_against_brute_force(spark):
    r = random.Random(5)
    data = [(d, s, f"https://{s}.example/{i}", r.choice(["a", "b", None]), r.choice("mn")) for d in DAY for s in "xyz" for i in range(12) if r.random() < 0.6 and not (s == "y" and d == DAY[2])]
    want, known = set(), {}
    last = {}
    for d in DAY:
        for s in "xyz":
            own = {f"{s}.example/{u.rsplit('/', 1)[1]}": (t, m) for dd, ss, u, t, m in data if dd == d and ss == s}
            if not own:
                continue
            now = {}
            for key, (t, m) in own.items():
                t = t if t is not None else known.get(key)
                known[key] = t
                now[key] = (t, m)
            if s in last:
                want |= {(key, d.isoformat(), "added") for key in now.keys() - last[s].keys()} | {(key, d.isoformat(), "removed") for key in last[s].keys() - now.keys()}
                want |= {(key, d.isoformat(), "changed") for key in now.keys() & last[s].keys() if now[key] != last[s][key]}
            last[s] = now
    assert changes(spark, data) == want and want


def test_index_is_kept_and_does_not_move(spark, tmp_path):
    """Another session goes on with the index; in its plan only the new snapshot is shuffled."""
    u, at = "https://a.example/p", str(tmp_path / "index")
    days = [[(DAY[0], "s", u + "1", "t1", "m"), (DAY[0], "s", u + "2", "t2", "m")], [(DAY[1], "s", u + "1", "t1x", "m")], [(DAY[2], "s", u + "2", None, "m"), (DAY[2], "s", u + "1", None, "m")]]
    first = snapshots.Index(spark, 3, at)
    first.advance(snapshots.pages_of(snap(spark, days[0])))
    first.advance(snapshots.pages_of(snap(spark, days[1])))
    again = snapshots.Index.open(spark, at, 2, 3)
    assert rows(again.advance(snapshots.pages_of(snap(spark, days[2])))) == [("s", "a.example/p2", 20108, 20101, "added")]
    new = snapshots.pages_of(snap(spark, days[2])).repartition(3, *snapshots.KEYS).groupBy(*snapshots.KEYS).agg(F.max("text_hash").alias("t"))
    plan = again.pages.join(new.hint("merge"), snapshots.KEYS, "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("annalist_")]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_orphans_kinds_and_hot_keys(spark, monkeypatch):
    t = lambda y: dt.datetime(y, 3, 1)
    links = spark.createDataFrame([("l1", " DOC_A ", "doc_b", t(2020)), ("l2", "doc_a", None, None), ("l3", "gone", "gone2", t(2022)), ("l4", "nowhere", "doc_b", t(2023)), ("l1", " DOC_A ", "doc_b", t(2020))] + [(f"h{i}", "hot", "doc_b", t(2023)) for i in range(50)], "link_id string, old_document_id string, new_document_id string, created_at timestamp")
    kids = orphans.references(links, "doc_links", "link_id", "created_at", {"old_document_id": "document", "new_document_id": "document"})
    parents = spark.createDataFrame([("document", "doc_a", t(2021)), ("document", "doc_b", t(2019)), ("document", "gone", t(2020)), ("document", "gone2", t(2021)), ("document", "gone2", t(2023))], "parent_table string, ref_key string, known_at timestamp")
    removals = spark.createDataFrame([("document", "gone", t(2021)), ("document", "gone2", t(2022)), ("document", "never", None)], "parent_table string, ref_key string, removed_at timestamp")
    want = [("doc_links", "l1", "old_document_id", "doc_a", "late", "2020-03"), ("doc_links", "l3", "old_document_id", "gone", "deleted", "2022-03"), ("doc_links", "l4", "old_document_id", "nowhere", "missing", "2023-03")]
    want += [("doc_links", f"h{i}", "old_document_id", "hot", "missing", "2023-03") for i in range(50)]
    assert rows(orphans.orphan_references(kids, parents, removals, 100)) == sorted(want, key=repr)
    monkeypatch.setattr(orphans, "max", lambda a, b: 10, raising=False)  # a limit of 10 rows makes one key hot
    assert rows(orphans.orphan_references(kids, parents, removals, 100)) == sorted(want, key=repr)
    assert orphans.orphan_references(kids.limit(0), parents.limit(0), removals.limit(0), 0).count() == 0


LOG = "key string, valid_from timestamp, recorded_at timestamp, lifecycle string, text string, leaf int, state string"


def _log(spark, n, seed=1):
    r = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    out = [(k, t0 + dt.timedelta(hours=r.randrange(300)), t0 + dt.timedelta(days=r.randrange(90)), r.choice([None, " active", "ACTIVE", "Amended "]), r.choice("ab"), 0, "z") for k in ["hot"] * n + ["p", "q", "r"] * 6]
    return out + [out[0], (None, t0, t0, "x", "y", 0, "z"), ("p", None, t0, "x", "y", 0, "z")]


def _brute(log, until=None):
    last = {}
    for k, f, rec, lc, tx, *_ in log:
        if k is None or f is None or (until and rec > until):
            continue
        v = (rec, lc.strip().upper() if lc else None, tx)
        if (k, f) not in last or tuple(x or "" for x in map(str, v)) > tuple(x or "" for x in map(str, last[(k, f)])) and v[0] >= last[(k, f)][0]:
            last[(k, f)] = v
    out = []
    for key in {k for k, _ in last}:
        prev, state = None, None
        for f in sorted(x for k, x in last if k == key):
            _, lc, tx = last[(key, f)]
            state = lc or state
            if (state, tx) != prev:
                out.append([key, f, None, state, tx])
                prev = (state, tx)
    for key in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == key), key=lambda o: o[1])
        for a, b in zip(own, own[1:]):
            a[2] = b[1]
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("least", [100_000, 20])
def test_history_by_merkle_comparison(spark, least, tmp_path):
    """With and without a hot key; later snapshots append only what changed, and another session goes on from the folder."""
    log = list({(r[0], r[1]): r for r in _log(spark, 150)}.values())
    df = spark.createDataFrame(log, LOG)
    state = F.upper(F.trim("lifecycle"))
    hot = skew.hot_keys(df, ["key"], 200, least, 512)
    assert (hot is None) == (least == 100_000)
    names = ("key", "valid_from", "valid_to", "state", "content")
    at = str(tmp_path / "h")
    for until in (dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1), None):
        h = history.History(spark, 64, at)  # opened anew
        h.apply(history.observations(df, "key", state, "text", None if until is None else F.lit(until)), hot)
        assert rows(h.table(), *names) == _brute(log, until)
    assert h.n == 3
    assert h.apply(history.observations(df, "key", state, "text"), hot).count() == 0
    assert spark.read.parquet(f"{at}/delta/step=4").count() == 0 and rows(h.table(), *names) == _brute(log)
    h.apply(history.observations(df, "key", state, "text", F.lit(dt.datetime(2024, 2, 1))), hot)  # back: states go again
    assert rows(h.table(), *names) == _brute(log, dt.datetime(2024, 2, 1))
    empty = history.History(spark, 64)
    empty.apply(history.observations(df.limit(0), "key", state, "text"), None)
    assert empty.table().count() == 0


def test_tree_descends_only_where_digests_differ(spark):
    """A change of one key shows in its leaf alone."""
    t = dt.datetime(2024, 1, 1)
    log = [(f"k{i}", t, t, "ACTIVE", "a", 0, "z") for i in range(300)]
    h = history.History(spark, 8192)
    assert h.shifts == [12, 6, 0]
    for change in (None, 7):
        df = spark.createDataFrame([(*r[:4], "b", *r[5:]) if i == change else r for i, r in enumerate(log)], LOG)
        leaves = h.apply(history.observations(df, "key", F.col("lifecycle"), "text"), None)
    assert leaves.count() == 1 and spark.read.parquet(f"{h.folder}/delta/step=2").count() == 1
    assert history.leaves_for(0) == 64 and history.leaves_for(40_000) == 16_384


VER = "entity_a string, entity_b string, version_id string, rank int, known_from long, known_to long, holds_from int, holds_to int, day string"
REQ = "entity_a string, entity_b string, request_id long, asked long, day int, version_id string"


def _asof_data(seed):
    r = random.Random(seed)
    some = lambda n: None if r.random() < 0.2 else r.randrange(n)
    versions = [(r.choice("AB"), r.choice(["1", None]), f"v{i}", some(3), some(50), some(50), some(30), some(30), "x") for i in range(60)] + [("H", "1", f"h{i:03d}", 1, i % 7, None, i % 20, 20 + i % 9, "x") for i in range(80)]
    requests = [(r.choice("AB"), r.choice(["1", None]), i, r.randrange(60), r.randrange(40), "y") for i in range(80)] + [("H", "1", 1000 + i, i, i % 30, "y") for i in range(90)] + [("H", "1", 5000, None, 3, "y"), ("none", "1", 6000, 3, 3, "y")]
    return requests + requests[:5], versions + versions[:5]


def _asof_brute(requests, versions):
    out = set()
    for a, b, q, at, day, _ in requests:
        ok = [(kf if kf is not None else -(10**9), rk if rk is not None else -(10**9), v) for va, vb, v, rk, kf, kt, hf, ht, _ in versions if at is not None and b is not None and (va, vb) == (a, b) and (kf is None or kf <= at) and (kt is None or kt > at) and (hf is None or hf <= day) and (ht is None or ht > day)]
        if ok:
            best = max(x[:2] for x in ok)
            out.add((q, min(x[2] for x in ok if x[:2] == best)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_bucket,per_block", [(20_000, 100_000), (20, 25)])
def test_asof_against_brute_force(spark, monkeypatch, per_bucket, per_block):
    """The second case splits an entity by its requests and by its versions."""
    monkeypatch.setattr(asof, "PER_BUCKET", per_bucket)
    monkeypatch.setattr(asof, "PER_BLOCK", per_block)
    requests, versions = _asof_data(3)
    got = asof.asof_answers(spark.createDataFrame(requests, REQ), spark.createDataFrame(versions, VER), 200, 150)
    assert rows(got.distinct(), "request_id", "version_id") == _asof_brute(requests, versions)
    assert asof.asof_answers(spark.createDataFrame([], REQ), spark.createDataFrame([], VER), 0, 0).count() == 0


def test_asof_intervals():
    for lo in range(9):
        for hi in range(lo, 12):
            held = set()
            for x in asof._intervals(lo, hi):
                level, place = x >> 32, x & 0xFFFFFFFF
                held |= set(range(place << level, (place + 1) << level))
            assert held == set(range(lo, hi))
