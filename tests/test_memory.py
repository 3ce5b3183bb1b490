"""The store as one object, and what is read without a model."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronofold.functions import language as L
from chronofold.operators.memory import Memory
from chronofold.operators.merging import clusters
from chronofold.sources.vocabulary import Predicate, Vocabulary, read_pack

ANCHOR = dt.datetime(2026, 9, 3, 15, 30)


@pytest.mark.parametrize(("said", "want"), [("yesterday", (dt.datetime(2026, 9, 2), "day")), ("3 days ago", (dt.datetime(2026, 8, 31), "day")), ("3 weeks ago", (dt.datetime(2026, 8, 13), "day")), ("last month", (dt.datetime(2026, 8, 1), "month")), ("in 2019", (dt.datetime(2019, 1, 1), "year")), ("two months ago", (dt.datetime(2026, 7, 3), "day")), ("0 days ago", None), ("20 dozen ago", None), ("99999 years ago", None), ("last winter", (dt.datetime(2025, 12, 1), "season")), ("next autumn", (dt.datetime(2027, 9, 1), "season")), ("this summer", (dt.datetime(2026, 6, 1), "season")), ("next week", (dt.datetime(2026, 9, 7), "week")), ("last year", (dt.datetime(2025, 1, 1), "year")), ("now", None), ("today", None), ("currently", None), ("blue moon", None)])
def test_relative_dates(said, want):
    assert L.resolve_date(said, ANCHOR) == want


def test_month_arithmetic_clamps():
    assert L.add_months(dt.datetime(2024, 3, 31), -1) == dt.datetime(2024, 2, 29)


@pytest.mark.parametrize(("text", "want"), [
    ("I moved to Lisbon last month.", [("lives_in", "Lisbon", 1, "last month")]), ("I'm vegan.", [("dietary_restriction", "vegan", 1, None)]), ("Do I live in Rome?", []), ("I might move. If I live in Rome, fine.", []),
    ("I no longer work at Acme.", [("works_at", "Acme", -1, None)]), ("I don't live in Paris anymore", [("lives_in", "Paris", -1, None)]), ("I work as a designer at Acme", [("works_at", "Acme", 1, None), ("job_title", "designer", 1, None)]),
    ("My name is Ada, and I like coffee and tea", [("name", "Ada", 1, None)]), ("I do not like it.", []), ("You know I love tea too!", [("likes", "tea", 1, None)]), ("I'm allergic to peanuts", [("allergic_to", "peanuts", 1, None)]), ("", []),
])
def test_plain_facts(text, want):
    assert list(L.facts(text)) == want


def test_intents(spark):
    rows = [("When did she move?", "temporal"), ("Who is the manager of Ann?", "relational"), ("What is her name?", "lookup"), ("tell me about Ann", "open"), ("the path between a and b", "relational")]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, "q string, want string").withColumn("got", L.intent(F.col("q"))).collect())


def test_closeness_and_excerpts():
    assert L.window_score(["a", "b"], "x a b x".split()) == 1.0
    assert L.window_score(["a", "b"], "a x x b".split()) == 0.875 and L.window_score(["a", "b"], ["a"]) == 0.5 and L.window_score(["a"], []) == 0.0
    text = "One thing. The cat sat. Another thing entirely. " + "Long tail. " * 60
    assert "cat" in L.excerpt(text, {"cat"}, 60) and len(L.excerpt(text, {"cat"}, 60)) <= 64 and L.excerpt("", {"x"}) == ""


def test_hashed_embeddings_are_units():
    a, b, c = (L.hash_embed(t) for t in ("the red house", "the red houses", "quantum flux"))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert abs(dot(a, a) - 1) < 1e-5 and dot(a, b) > 0.6 > 0.3 > dot(a, c) and not any(L.hash_embed(""))


def test_greedy_clusters_need_equal_digits():
    assert clusters(["room 12 on the left side", "room 12 on the left side.", "room 13 on the left side"], 0.9) == [0, 0, 2]


def test_predicates_resolve():
    v = Vocabulary([Predicate("home_town", aliases=("from",))])
    assert [v.resolve(x)[1] for x in ("lives_in", "from", "is allergic to", "like", "flies kites")] == ["canonical", "alias", "strict", "strict", "novel"]
    assert v.resolve("working on")[0] == "working_on" and "mood" in v.functional() and v.learn(Predicate("x")) and not v.learn(Predicate("x"))
    assert read_pack('[predicates.decided]\ncardinality = "one"\naliases = ["chose"]')[0] == Predicate("decided", "one", aliases=("chose",))


def test_memory(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m", user="ann")
    day = lambda n: dt.datetime(2024, 1, n)
    assert m.remember([{"subject": "user", "predicate": "lives in", "object": "Berlin", "valid_from": day(1), "arrived_at": day(1)}, {"subject": "user", "predicate": "lives_in", "object": "London", "valid_from": day(5), "arrived_at": day(5)}, {"subject": "user", "predicate": "likes", "object": "tea", "valid_from": day(2), "arrived_at": day(2)}]) == 3
    now = lambda x: sorted(r.object for r in x.collect())
    assert now(m.get_all()) == ["London", "tea"] and now(m.get_all(as_of="2024-01-03")) == ["Berlin", "tea"]
    assert [r.object for r in m.history("user", "lives in").orderBy("pos").collect()] == ["Berlin", "London"]
    assert now(m.since("2024-01-03")[0]) == ["London"] and now(m.since("2024-01-03")[1]) == ["Berlin"]
    assert m.scope("bob").get_all().count() == 0
    m.forget("user", "lives_in")
    assert now(m.get_all()) == ["tea"]
    turns = spark.createDataFrame([(1, "I work at Acme.", day(9))], "id long, content string, ts timestamp_ntz")
    assert m.add(turns) == 1 and now(m.get_all()) == ["Acme", "tea"]
    gone = m.get_all().filter("object = 'tea'").first().id
    bob = m.scope("bob")
    assert bob.remember([{"subject": "user", "predicate": "likes", "object": "rum", "usr": "ann"}]) == 1
    assert now(bob.get_all()) == ["rum"] and now(m.get_all()) == ["Acme", "tea"]
    assert bob.erase([gone]) == 0 and now(m.get_all()) == ["Acme", "tea"]
    assert m.erase([gone]) == 0 and now(m.get_all()) == ["Acme"] and now(bob.get_all()) == ["rum"]
    with pytest.raises(ValueError):
        m.get_all(as_of="2024-01-01", valid_at="2024-01-01")


def test_closing_by_id_and_in_bulk(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/c", user="ann")
    day = lambda n: dt.datetime(2024, 1, n)
    m.remember([{"subject": "user", "predicate": "likes", "object": x, "valid_from": day(k), "arrived_at": day(k)} for k, x in enumerate(("green tea", "black tea", "rum"), 1)])
    ids = {r.object: r.id for r in m.get_all().collect()}
    now = lambda: sorted(r.object for r in m.get_all().collect())
    assert m.get(ids["rum"]).count() == 1 and m.scope("bob").get(ids["rum"]).count() == 0
    assert not m.scope("bob").delete(ids["rum"]) and not m.delete("cl_none") and now() == ["black tea", "green tea", "rum"]
    assert m.delete(ids["rum"], reason="wrong") and now() == ["black tea", "green tea"]
    assert m.get(ids["rum"]).first().invalidated_at is not None and m.delete(ids["rum"])
    m.remember([{"subject": "user", "predicate": "likes", "object": "rum"}])
    assert now() == ["black tea", "green tea", "rum"]
    new = m.supersede(ids["black tea"], {"object": "white tea", "valid_from": day(20)})
    assert m.supersede(ids["black tea"], {"object": "white tea", "valid_from": day(20)}) == new
    assert now() == ["green tea", "rum", "white tea"] and m.get(ids["black tea"]).first().valid_to == day(20)
    hits, token = m.matching("what tea is it", close="retired")
    assert sorted(r.object for r in hits) == ["green tea", "white tea"]
    for bad, how in ((token[:-1] + "x", "retired"), (token, "ended")):
        with pytest.raises(PermissionError):
            m.forget_matching(bad, how)
    with pytest.raises(PermissionError):
        m.scope("bob").forget_matching(token)
    assert m.forget_matching(token) == 2 and now() == ["rum"]
    with pytest.raises(LookupError):
        m.forget_matching(token)
    with pytest.raises(ValueError):
        m.delete(new, reason=" ")
    assert m.erase([ids["green tea"]]) == 0 and m.assertions().filter(F.col("closes") == ids["green tea"]).count() == 0
