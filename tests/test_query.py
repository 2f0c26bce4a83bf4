from __future__ import annotations

import json

import pytest

from ledgerleaf.errors import QueryError, TenantRequired
from ledgerleaf.functions import fulltext, jsonpath
from ledgerleaf.plans.predicate import Predicate as P
from ledgerleaf.plans.query import Collection, CompiledQuery, DocumentQuery

CUSTOMERS = [
    {"id": "1", "email": "alice@x.com", "first_name": "Alice", "age": 28, "tags": ["vip", "beta"], "active": True, "balance": 120.5},
    {"id": "2", "email": "bob@x.com", "first_name": "Bob", "age": 35, "tags": ["standard"], "active": True, "balance": 80.0},
    {"id": "3", "email": "carol@x.com", "first_name": "Carol", "age": 42, "tags": ["vip", "newsletter"], "active": False, "balance": -15.75},
] + [{"id": str(100 + i), "email": f"u{i}@x.com", "first_name": f"U{i}", "age": 25 + i, "tags": ["bulk"], "active": i % 2 == 0, "balance": 60.0 + i} for i in range(30)]


def docs(spark, rows):
    frame = spark.createDataFrame([(r["id"], json.dumps(r)) for r in rows], "id string, j string")
    return DocumentQuery(Collection.from_json(frame, "id", "j"))


@pytest.fixture(scope="module")
def customers(spark):
    return docs(spark, CUSTOMERS)


def ids(query):
    return sorted(r.id for r in query.fetch_all())


def test_paths():
    assert jsonpath.parse("a.b[0]..c") == ("a", "b", "0", "c")
    assert jsonpath.parse(["x", "y.z"]) == ("x", "y.z")
    assert jsonpath.variant_paths(("a", "0")) == ['$["a"][0]', '$["a"]["0"]']


def test_predicates(customers):
    assert "3" not in ids(customers.filter(P.eq("active", True)))
    assert ids(customers.filter(P.contains("tags", ["vip"]))) == ["1", "3"]
    assert ids(customers.filter(P.between("balance", -20, 0))) == ["3"]
    assert ids(customers.filter(P.is_in("first_name", ["Bob", "Alice"]))) == ["1", "2"]
    assert ids(customers.filter(P.is_in("first_name", []))) == []
    assert ids(customers.filter(P.iregex("email", "^ALICE"))) == ["1"]
    assert ids(customers.filter(P.regex("email", "^ALICE"))) == []
    assert len(ids(customers.filter(P.both()))) == len(CUSTOMERS)
    assert ids(customers.filter(P.either())) == []


def test_sort_select_page(customers):
    q = customers.filter(P.contains("tags", ["vip"])).order_by_number("balance", True)
    assert [json.loads(r.json) for r in q.select_fields([("name", "first_name"), ("b", "balance")]).to_json_df().collect()] == [{"name": "Alice", "b": 120.5}, {"name": "Carol", "b": -15.75}]
    page = customers.filter(P.gt("age", 30)).order_by("email").page(2, 5)
    assert len(page.fetch_all()) == 5
    assert len(customers.page(0, 0).fetch_all()) == 1
    assert len(customers.limit(-3).fetch_all()) == 0
    assert customers.filter(P.eq("id", "2")).fetch_one().id == "2"
    assert customers.filter(P.eq("id", "none")).fetch_first() is None


def test_null_logic(spark):
    q = docs(spark, [{"id": "a", "x": 1}, {"id": "b"}, {"id": "c", "x": None}])
    assert ids(q.filter(P.ne("x", 1))) == ["c"]
    assert ids(q.filter(P.exists("x"))) == ["a", "c"]
    assert ids(q.filter(P.gt("x", 0))) == ["a"]
    assert [r.id for r in q.order_by_number("x").fetch_all()][0] == "a"
    assert [r.id for r in q.order_by_number("x", True).fetch_all()][-1] == "a"


def test_json_equality(spark):
    q = docs(spark, [{"id": "a", "v": "12.5"}, {"id": "b", "v": 12.5}, {"id": "c", "v": [1, {"k": 2.0}]}, {"id": "d", "v": {"x": 1, "y": [3]}}])
    assert ids(q.filter(P.eq("v", 12.5))) == ["b"]
    assert ids(q.filter(P.eq("v", "12.5"))) == ["a"]
    assert ids(q.filter(P.eq("v", [1, {"k": 2}]))) == ["c"]
    assert ids(q.filter(P.eq("v", {"y": [3], "x": 1.0}))) == ["d"]
    assert ids(q.filter(P.contains("v", {"y": []}))) == ["d"]
    assert ids(q.filter(P.contains("v", 1))) == ["c"]


def test_includes(spark):
    users = spark.createDataFrame([("u1", '{"name":"Alice"}'), ("u2", '{"name":"Bob"}')], "id string, j string")
    users = Collection.from_json(users, "id", "j")
    q = docs(spark, [{"id": str(i), "user_id": u, "amount": a} for i, (u, a) in enumerate([("u1", 10), ("u1", 7), ("u2", 5), ("u2", 8)])]).include(users, "user_id", "id", "u")
    rows = q.group_by_from("u", "name").sum("amount", "total").to_df().collect()
    assert sorted(r.total for r in rows) == [13, 17] and rows[0].asDict().keys() == {"total"}
    found = q.order_by_from("u", "name").order_by_number("amount", True).select_fields([("a", "amount")]).select_from("u", "n", "name")
    assert [json.loads(r.json) for r in found.to_json_df().collect()] == [{"a": 10, "n": "Alice"}, {"a": 7, "n": "Alice"}, {"a": 8, "n": "Bob"}, {"a": 5, "n": "Bob"}]
    with pytest.raises(QueryError):
        q.select_from("zzz", "n", "name").to_df()


def test_full_text(spark):
    q = docs(spark, [{"id": "1", "title": "Alice in Rustland", "amount": 10}, {"id": "2", "title": "Bob the Builder", "amount": 20}])
    assert ids(q.full_text_search("Alice")) == ["1"]
    assert ids(q.full_text_search("builders bob")) == ["2"]
    assert ids(q.full_text_search("the")) == []
    assert ids(q.full_text_search("the", "simple")) == ["2"]
    assert [fulltext.stem(w) for w in ("running", "caresses", "ponies", "relational", "hopping", "agreed")] == ["run", "caress", "poni", "relat", "hop", "agre"]


def test_promoted_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) as name", "id * 2 as twice").write.parquet(str(tmp_path / "t"))
    q = DocumentQuery(Collection.from_table(spark.read.parquet(str(tmp_path / "t")), "id")).filter(P.eq("name", "3")).select_field("id", "id")
    plan = q.explain()
    assert "EqualTo(name,3)" in plan and "twice" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert [r.id for r in q.fetch_all()] == [3]


def test_compiled_and_tenant(spark):
    frame = spark.createDataFrame([("a", "t1", "{}"), ("b", "t2", "{}")], "id string, tenant_id string, j string")
    from dataclasses import replace

    c = replace(Collection.from_json(frame, "id", "j"), tenant_col="tenant_id")
    with pytest.raises(TenantRequired):
        DocumentQuery(c).to_df()

    class Own(CompiledQuery):
        def configure(self, query):
            return query.for_tenant("t2")

    assert ids(Own().on(c)) == ["b"]


def test_languages_of_full_text(spark):
    from ledgerleaf.errors import QueryError
    from ledgerleaf.functions.fulltext import lexemes_of

    for config, text, other in (("german", "Die Häuser und das Kind", "haus kinder"), ("french", "les chevaux et la maison", "cheval maisons"), ("spanish", "las canciones y los peces", "pez")):
        assert set(lexemes_of(other, config)) & set(lexemes_of(text, config)), config
    assert "und" not in lexemes_of("Kind und Haus", "german") and lexemes_of("The Runs", "simple") == ["the", "runs"]
    docs = spark.createDataFrame([(1, "Die Kinder"), (2, "das Haus")], "id long, text string")
    q = DocumentQuery(Collection(docs, "id", "text", None, search_col="text", promoted={"id": "id"}))
    assert [r.id for r in q.full_text_search("Kindern", "german").select_field("id", "id").to_df().collect()] == [1]
    with pytest.raises(QueryError):
        q.full_text_search("a b", "klingon").to_df()

