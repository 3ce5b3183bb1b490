"""Small cases with known answers."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronofold.functions import clocks as C
from chronofold.functions import filters, scoring
from chronofold.functions import text as TX
from chronofold.operators import graph, maintenance, reconcile, retrieval, scope, temporal
from chronofold.sources import documents as D

CLAIM = "id string, object string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, invalidated_at timestamp_ntz, expires_at timestamp_ntz, fact_key string"


def day(month, n=1):
    return dt.datetime(2026, month, n)


@pytest.fixture(scope="module")
def story(spark):
    rows = [("1", "Berlin", day(1), day(7), day(1), day(8), None, "k"), ("2", "Paris", day(7), None, day(7), day(8), None, "k"), ("3", "Rome", day(3), day(7), day(8), None, None, "k"), ("4", "Lisbon", day(7), None, day(8), None, None, "k")]
    return spark.createDataFrame(rows, CLAIM)


def objects(df):
    return sorted(r.object for r in df.collect())


@pytest.mark.parametrize(("known", "valid", "want"), [("2026-09-01", "2026-09-01", ["Lisbon"]), ("2026-09-01", "2026-06-01", ["Rome"]), ("2026-07-15", "2026-07-15", ["Paris"]), ("2026-06-01", "2026-06-01", ["Berlin"]), ("2025-01-01", "2026-06-01", [])])
def test_four_clocks(story, known, valid, want):
    assert objects(temporal.read(story, [C.LIVE], known, valid, "2026-09-01")) == want


def test_states(story):
    at = "2026-09-01"
    assert objects(story.filter(C.state_expr([C.ENDED], at, at))) == ["Rome"]
    assert objects(story.filter(C.state_expr([C.RETIRED], at, at))) == ["Berlin", "Paris"]
    assert objects(story.filter(C.state_expr([C.LIVE, C.ENDED], at, at))) == ["Lisbon", "Rome"]
    assert objects(story.filter(C.state_expr([C.LIVE, C.RETIRED], at, at))) == ["Berlin", "Lisbon", "Paris"]
    assert len(objects(story.filter(C.state_expr(C.STATES, at, "2000-01-01")))) == 4
    assert objects(story.filter(C.state_expr([C.LIVE], at, "2026-07-15", "2026-06-15"))) == ["Lisbon", "Rome"]
    with pytest.raises(ValueError):
        C.state_expr([], at, at)
    assert sorted(r.s for r in story.select(C.stored_state().alias("s")).collect()) == ["ended", "live", "retired", "retired"]


def test_delta_is_two_set_differences(story):
    added, gone = temporal.delta(story, "2026-06-01", "2026-09-01", "2026-09-01")
    assert (objects(added), objects(gone)) == (["Lisbon"], ["Berlin"])


def test_expiry_is_on_the_wall_clock(spark):
    df = spark.createDataFrame([("1", "x", day(1), None, day(1), None, day(3), "k")], CLAIM)
    assert temporal.read(df, [C.LIVE], "2026-02-01", "2026-02-01", "2026-02-01").count() == 1
    assert temporal.read(df, [C.LIVE], "2026-02-01", "2026-02-01", "2026-04-01").count() == 0


def test_overlap_of_half_open_intervals(spark):
    rows = [(1, 2, 2, 3, False), (1, 3, 2, None, True), (1, None, 5, None, True), (2, 2, 1, 3, False), (1, 4, 2, 2, False)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", C.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect())


@pytest.mark.parametrize(("surface", "key"), [("Acme", "acme"), ("  Acme   Corp  ", "acme"), ("Acme, Inc.", "acme"), ("The Acme Corporation", "acme"), ("Acme GmbH", "acme"), ("Zoë", "zoe"), ("O'Reilly", "oreilly"), ("...", ""), ("Inc", "inc"), ("The", "the"), ("C++", "c++"), ("C#", "c#"), ("C", "c"), ("A-", "a-"), ("x-ray", "x ray"), ("the the band", "band"), (None, "")])
def test_entity_keys(surface, key):
    assert TX.entity_key(surface) == key


def test_long_entity_keys_fold_to_themselves():
    key = TX.entity_key("the customer said the renewal would be decided after the audit " * 60)
    assert len(key) <= TX.ENTITY_KEY_MAX and TX.entity_key(key) == key


def test_redaction(spark):
    rows = [("mail me at bob@corp.example", "mail me at [redacted:email]"), ("call me on 555-123-4567.", "call me on [redacted:phone]."), ("card 4111 1111 1111 1111 ok", "card [redacted:card] ok"), ("order 4111 1111 1111 1112 ok", None), ("no 5551234567", "no 5551234567")]
    got = spark.createDataFrame(rows, "t string, want string").withColumn("got", TX.redact(F.col("t"))).collect()
    assert all(r.want is None or r.got == r.want for r in got)


def test_gate(spark):
    rows = [("", "user", "no_content"), ("I live here.", "assistant", "assistant_turn"), ("ok thanks!", "user", "ack_only"), ("Berlin", "user", "too_short"), ("Where do you live?", "user", "question"), ("I live in Berlin, what is near?", "user", "question"), ("I live in Berlin. What is near?", "user", "has_declarative"), (None, None, "no_content")]
    got = spark.createDataFrame(rows, "c string, r string, want string").withColumn("got", TX.gate_reason(F.col("c"), F.col("r"))).collect()
    assert [(r.c, r.got) for r in got if r.got != r.want] == []


def test_metadata_filter_is_typed(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('{"k": true}',), ('{"k": "1"}',), ('{"k": 1.0}',), ("{}",), (None,), ("nonsense",)], "m string")
    one = lambda v: sorted(r.m for r in df.filter(filters.meta_filter(F.col("m"), {"k": v})).collect())
    assert one(1) == ['{"k": 1.0}', '{"k": 1}'] and one(True) == ['{"k": true}'] and one("1") == ['{"k": "1"}'] and len(one([1, "1"])) == 3
    with pytest.raises(ValueError):
        filters.meta_filter(F.col("m"), {"k'; drop": 1})


def test_scope_chain_and_shadow(spark):
    reader = spark.createDataFrame([("r", "t", "u", "p", "a", "s")], "reader string, tenant string, usr string, project string, agent string, session string")
    assert scope.chain(reader).count() == 7
    rows = [("own", "t", "u", None, "a", "s"), ("user", "t", "u", None, None, None), ("sibling", "t", "u", None, "a", "s2"), ("tenant", "t", None, None, None, None), ("other", "t2", "u", None, None, None)]
    claims = spark.createDataFrame([(*r, "slot") for r in rows], "id string, tenant string, usr string, project string, agent string, session string, fact_key string")
    seen = scope.visible(claims, reader)
    assert sorted(r.id for r in seen.collect()) == ["own", "tenant", "user"]
    assert [r.id for r in scope.shadow(seen).collect()] == ["own"]
    key = spark.range(1).select(scope.scope_key(F.lit("t"), F.lit("a/b*"), F.lit(None).cast("string")).alias("k")).first().k
    assert key == "t/a%2Fb%2A/*"


def test_walks_repeat_no_node_and_damp_later_hops(spark):
    edges = spark.createDataFrame([("a", "p", "b", 1.0), ("b", "q", "c", 0.5), ("c", "r", "a", 1.0)], "src string, predicate string, tgt string, confidence double")
    got = {tuple(r.nodes): r.score for r in graph.walk(edges, spark.createDataFrame([("a",)], "seed string"), 3).collect()}
    assert got[("a", "b")] == 1.0 and got[("a", "b", "c")] == 0.375 and ("a", "c", "b") in got
    assert all(len(set(n)) == len(n) for n in got)
    assert {(r.node, r.hops) for r in graph.reachable(edges, spark.createDataFrame([("a",)], "seed string"), 2).collect()} == {("b", 1), ("c", 1)}


def test_rank_fusion_and_slot_cap(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "qid int, id string, rank int")
    assert {r.id: r.fused for r in retrieval.fuse([(a, 1.0), (b, 1.0), (b, 0.0)]).collect()} == {"x": round(1 / 61, 6), "y": round(1 / 62 + 1 / 61, 6)}
    rows = spark.createDataFrame([(1, i, "s" if i < 4 else "t", s) for i, s in enumerate([0.9, 0.8, 0.7, 0.6, 0.5, 0.0])], "qid int, id int, slot string, score double")
    assert [r.id for r in retrieval.slot_cap(rows).orderBy("pos").collect()] == [0, 1, 4, 2, 3, 5]


def test_vector_topk_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.0] * 8), (301, [1.0])]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    q = v.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    got = {(r.qid, r["rank"]): r.id for r in retrieval.vector_topk(v, q, 3).collect()}

    def cos(a, b):
        n = lambda x: sum(y * y for y in x) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / (n(a) * n(b))

    for qid in range(0, 300, 50):
        best = sorted(((-round(cos(rows[qid][1], x), 5), i) for i, x in rows[:300]))[:3]
        assert [got[qid, k + 1] for k in range(3)] == [i for _, i in best]
    assert not any(k[0] == 300 for k in got)


def test_scores(spark):
    row = spark.range(1).select(scoring.quality(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("q"), scoring.lexical_relevance(F.lit(3.0), F.lit(2)).alias("l"), scoring.reinforced(F.lit(1.0), F.lit(1.0)).alias("r"), scoring.evidence([(F.lit(None).cast("double"), F.lit(True), 1.0), (F.lit(0.8), F.lit(True), 1.0), (F.lit(None).cast("double"), F.lit(False), 9.0)]).alias("e")).first()
    assert (row.q, row.l, round(row.r, 6), row.e) == (1.0, 0.5, 1.025, 0.4)


def said(i, obj, start, told, polarity=1, confidence=1.0, predicate="lives_in"):
    return {"id": f"c{i}", "predicate": predicate, "object": obj, "polarity": polarity, "valid_from": day(start), "arrived_at": day(told), "confidence": confidence}


def test_fold_supersedes_reinforces_and_keeps_late_facts():
    rows = {r["id"]: r for r in reconcile.fold([said(1, "A", 1, 1), said(2, "C", 7, 7), said(3, "B", 3, 8), said(4, "C", 8, 9)], {"lives_in"})}
    assert rows["c1"]["valid_to"] == day(7) and rows["c1"]["closed_by"] == "c2"
    assert rows["c3"]["valid_to"] == day(7) and rows["c3"]["closed_by"] is None
    assert "c4" not in rows and rows["c2"]["obs_count"] == 2


def test_fold_retracts_and_disputes():
    rows = {r["id"]: r for r in reconcile.fold([said(1, "A", 1, 1), said(2, "B", 3, 3, confidence=0.4), said(3, "", 5, 5, polarity=-1), said(4, "", 6, 6)], {"lives_in"})}
    assert rows["c2"]["action"] == "dispute" and rows["c1"]["closed_by"] == "c3" and rows["c1"]["valid_to"] == day(5) and "c4" not in rows
    many = reconcile.fold([said(1, "tea", 1, 1, predicate="likes"), said(2, "coffee", 2, 2, predicate="likes")], {"lives_in"})
    assert [r["valid_to"] for r in many] == [None, None]


def test_fold_on_spark_is_the_fold(spark):
    rows = [("s", *said(i, o, a, b).values()) for i, (o, a, b) in enumerate([("A", 1, 1), ("C", 7, 7), ("B", 3, 8)])]
    df = spark.createDataFrame(rows, "subject string, id string, predicate string, object string, polarity int, valid_from timestamp_ntz, arrived_at timestamp_ntz, confidence double")
    got = {r.id: r.valid_to for r in reconcile.reconcile(df, {"lives_in"}).collect()}
    assert got == {"c0": day(7), "c1": None, "c2": day(7)}


def test_html_prefers_the_article():
    text, title = D.html_to_text("<html><head><title> A  b </title><script>x</script></head><body><nav>menu</nav><article><h1>Head</h1><p>one &amp; two<br>three</p></article><footer>f</footer></body></html>")
    assert title == "A b" and text == "Head\n\none & two\nthree"
    assert D.html_to_text("<p>only <b>body</b>")[0] == "only body" and D.html_to_text(None) == ("", "")
    assert D.html_to_text("<head><title>Page</title><body><p>a<canvas>no</canvas><object>no</object><svg><title>Drawing</title></svg> b</nav> c</p>") == ("a b c", "Page")


def test_chunks_cover_the_text_and_stay_put():
    rng = random.Random(2)
    lines = [" ".join(rng.choices("lorem ipsum dolor sit amet consectetur".split(), k=rng.randint(4, 30))) + "." for _ in range(120)]
    text = "\n".join(lines) + "\n" + "x" * 2500
    got = D.chunks(text)
    assert all(len(c) <= D.CHUNK + D.OVERLAP + 2 for c in got) and all(any(x in c for c in got) for x in lines)
    again = D.chunks(text.replace(lines[60], lines[60] + " Edited."))
    assert len(set(got) - set(again)) <= 4
    assert D.chunks(None) == D.chunks("  \n ") == [] and D.chunks("a\r\nb") == ["a\nb"]


def test_kinds_of_content(spark):
    rows = [(b"%PDF-1.7", "pdf"), (b"\x89PNG\r\n", "png"), (b"  <!DOCTYPE html><p>", "html"), (b"plain", "text")]
    got = spark.createDataFrame(rows, "c binary, want string").withColumn("got", D.kind_of(F.col("c"))).collect()
    assert all(r.got == r.want for r in got)


def test_versions_swap_and_old_ones_go(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    maintenance.save(spark.range(3), root, 1)
    maintenance.save(spark.range(2), root, 2)
    assert maintenance.load(spark, root).count() == 2
    maintenance.expunge(spark, root)
    assert not list((tmp_path / "store").glob("v=*1")) and maintenance.load(spark, root).count() == 2


def test_close_out(spark, story):
    both = {r.id: (r.valid_to, r.invalidated_at) for r in maintenance.close_out(story, F.lit(True), "2026-10-01", "ended").collect()}
    assert both["4"] == (day(10), None) and both["3"][0] == day(7) and both["2"] == (None, day(8))
    assert maintenance.close_out(story, F.col("id") == "4", "2026-10-01").filter("invalidated_at IS NULL").count() == 1


def test_bm25_is_the_formula(spark):
    import math
    import random
    from collections import Counter

    from chronofold.operators import retrieval as R

    rng = random.Random(5)
    vocabulary = [f"w{k}x" for k in range(40)]
    texts = {f"d{k:04}": " ".join(rng.choices(vocabulary, range(40, 0, -1), k=rng.randint(0, 12))) for k in range(1300)} | {"null": None, "copy1": "w1x w2x", "copy2": "w1x w2x"}
    asked = {1: "w1x w2x nowhere", 2: "w39x", 3: "", 4: "nowhere"}
    docs = spark.createDataFrame([*texts.items(), (None, "w1x")], "id string, text string").repartition(5)
    all_words = [(i, (t or "").split()) for i, t in [*texts.items(), (None, "w1x")]]
    n, mean = len(all_words), sum(len(w) for _, w in all_words) / (len(all_words) - 1)  # the one null has no length
    df = Counter(t for _, w in all_words for t in set(w))
    want = set()
    for qid, q in asked.items():
        scores = []
        for i, w in all_words:
            hit = [t for t in q.split() if t in w]
            if hit and i is not None and not i.startswith("copy1"):
                scores.append((-round(sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in hit), 6), i))
        want |= {(qid, i, round(-x, 5), r + 1) for r, (x, i) in enumerate(sorted(scores)[:9])}
    found = R.bm25(docs, spark.createDataFrame(list(asked.items()), "qid int, text string"), 9, among=F.col("id") != "copy1")
    assert {(r.qid, r.id, round(r.bm25, 5), r["rank"]) for r in found.collect()} == want
    assert R.bm25(docs, spark.createDataFrame([(9, "")], "qid int, text string"), 9).count() == R.bm25(docs.limit(0), spark.createDataFrame([(9, "w1x")], "qid int, text string"), 9).count() == 0
