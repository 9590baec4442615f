import gc

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillspark import QueryError, Store, expr, register, register_aggregate, release, select
from quillspark.errors import AggregateError, AliasError, ParameterError
from quillspark.functions.registry import MACROS

THING = [
    {"id": 1, "name": "Apple", "calories": 95, "type_id": 1},
    {"id": 2, "name": "Banana", "calories": 105, "type_id": 1},
    {"id": 3, "name": "Cake", "calories": 235, "type_id": 2},
]
TYPE = [{"id": 1, "name": "Vegetable"}, {"id": 2, "name": "Mineral"}]
PIE = {"id": 4, "name": "Pie", "calories": 300, "type_id": 3}


@pytest.fixture
def thing(spark):
    return Store.rows(THING)


@pytest.fixture
def more(spark):
    return Store.rows([*THING, PIE])


@pytest.fixture
def type_(spark):
    return Store.rows(TYPE)


def test_projection_forms(thing):
    assert rows(select("thing").from_(thing=thing)()) == sorted(((t["id"], t["name"], t["calories"], t["type_id"]) for t in THING), key=repr)
    assert select("thing.calories * 2").from_(thing=thing)().columns == ["value"]
    assert rows(select(n="thing.name").from_(thing=thing)()) == [("Apple",), ("Banana",), ("Cake",)]
    assert select({"n": "thing.name", "c": F.col("thing.calories")}).from_(thing=thing)().columns == ["n", "c"]
    assert select(row="thing").from_(thing=thing)().first().row.name == "Apple"
    assert "_pk" not in select("*").from_(thing=thing)().columns


def test_parameters_and_literals(thing):
    q = select(n="thing.name").from_(thing=thing).where("thing.id = :a OR thing.id = :b")
    assert rows(q(a=1, b=2)) == [("Apple",), ("Banana",)]
    assert rows(q({"a": 3, "b": 3})) == [("Cake",)]
    with pytest.raises(ParameterError):
        q(a=1)
    assert rows(select(n="t.name").from_(t=thing).where("t.id = ?", 2).where("t.name = ?", "Banana")()) == [("Banana",)]
    assert rows(select(n="t.name").from_(t=thing).where(lambda p: F.col("t.id") == p.x)(x=3)) == [("Cake",)]
    assert select(v=expr("?", "it's \\ ':x' \" ok")).from_(t=thing)().first().v == "it's \\ ':x' \" ok"
    assert rows(select(n="t.name").from_(t=thing).where("t.name = ':a'")()) == []
    with pytest.raises(ParameterError):
        select(n="t.name").from_(t=thing).where("t.id = ?")()


def test_joins(thing, more, type_):
    on = "type.id = thing.type_id"
    named = select(t="thing.name", k="type.name")
    assert rows(named.from_(thing=more).join(type=type_).on(on)()) == [("Apple", "Vegetable"), ("Banana", "Vegetable"), ("Cake", "Mineral")]
    assert ("Pie", None) in rows(named.from_(thing=more).left_join(type=type_).on(on)())
    assert rows(named.from_(thing=more).anti_join(type=type_).on(on)()) == [("Pie", None)]
    assert len(rows(named.from_(thing=thing, type=type_)())) == 6
    assert rows(named.from_(thing=thing, type=type_).where(on)()) == [("Apple", "Vegetable"), ("Banana", "Vegetable"), ("Cake", "Mineral")]
    lone = Store.rows([*TYPE, {"id": 9, "name": "Lone"}])
    full = rows(named.from_(thing=more).full_join(type=lone).on(on)())
    assert ("Pie", None) in full and (None, "Lone") in full and len(full) == 5
    assert (None, "Lone") in rows(named.from_(thing=more).right_join(type=lone).on(on)())
    assert rows(select(n="thing.name").from_(thing=more).left_join(type=type_).on(on).where("missing(type)")()) == [("Pie",)]
    pair = select(n="thing.name", a="c.name", b="d.name").from_(thing=more).left_join(c=type_, d=type_).on("c.id = thing.type_id AND d.id = c.id")()
    assert ("Pie", None, None) in rows(pair)


def test_implicit_join_is_no_product(thing, type_):
    plan = select(n="thing.name").from_(thing=thing, type=type_).where("type.id = thing.type_id")()._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join" in plan


def test_outer_join_placement(thing, more, type_):
    ansi = select(n="thing.name", k="type.name").from_(thing=more).left_join(type=type_).on("type.id = thing.type_id AND thing.id = 1")
    assert len(rows(ansi())) == 4
    assert rows(ansi.compat()()) == [("Apple", "Vegetable")]
    later = select(n="thing.name", k="type.name").from_(thing=more).left_join(type=type_).on("type.id = thing.type_id").where("type.id = 1")
    assert len(rows(later())) == 2
    assert len(rows(later.compat()())) == 4  # acts within the join


def test_group(spark):
    quartile = Store.rows([{"quartile": i // 25, **({"i": i} if i else {})} for i in range(100)])
    q = select(q="t.quartile", a="avg(t.i)", n="count(t.i)", mx="max(t.i)", mn="min(t.i)", s="sum(t.i)").from_(t=quartile).group_by("t.quartile")
    assert rows(q()) == [(0, 12.5, 24, 24, 1, 300), (1, 37.0, 25, 49, 25, 925), (2, 62.0, 25, 74, 50, 1550), (3, 87.0, 25, 99, 75, 2175)]
    assert rows(select(q="t.quartile", m="sum(t.i) / count(t.i) + t.quartile").from_(t=quartile).group_by("t.quartile").where("m > ?", 80)()) == [(3, 90.0)]
    assert rows(select(q="t.quartile", s="sum(t.i)").from_(t=quartile).group_by("t.quartile").order_by("s").desc.select(s="s")()) == [(1550,), (2175,), (300,), (925,)]
    empty = Store.rows([{"g": 1, "x": None}], schema="g int, x int")
    assert rows(select(s="sum(e.x)", a="avg(e.x)", n="count(e.x)").from_(e=empty).group_by("e.g")()) == [(0, None, 0)]
    assert rows(select(n="count(1)").from_(t=quartile).where("t.i > 1000").group_by("1")()) == []
    assert rows(select(odd="t.quartile % 2", n="count(*)").from_(t=quartile).group_by("t.quartile % 2")()) == [(0, 50), (1, 50)]
    assert {r[1] for r in rows(select(q="t.quartile", any="t.i").from_(t=quartile).group_by("t.quartile")())} <= {None, *range(100)}
    register_aggregate("product_all", lambda c: F.product(c))
    assert rows(select(p="product_all(t.i)").from_(t=quartile).where("t.i < 5").group_by("1")()) == [(24.0,)]


def test_order(spark):
    s = Store.rows([{"id": 1, "n": "b"}, {"id": 2, "n": "a"}, {"id": 3, "n": None}, {"id": 4, "n": "b"}])
    base = select(id="s.id").from_(s=s)
    ids = lambda q: [r.id for r in q().collect()]
    assert ids(base.order_by("s.n").order_by("s.id")) == [2, 1, 4, 3]
    assert ids(base.order_by("s.n").desc.order_by("s.id").desc) == [4, 1, 2, 3]
    assert ids(base.order_by("s.n").nulls_first.order_by("s.id")) == [3, 2, 1, 4]
    assert ids(base.order_by("s.n").desc.nulls_first.order_by("s.id").asc) == [3, 1, 4, 2]
    assert ids(base.order_by("s.id").order(-1)) == [4, 3, 2, 1]
    assert ids(base.order_by("s.n").nulls(-1).order_by("s.id")) == [3, 2, 1, 4]
    for wrong in (lambda: base.order_by("s.n").order(2), lambda: base.order_by("s.n").nulls(0), lambda: base.asc):
        with pytest.raises(QueryError):
            wrong()


def test_sets_subqueries_memo(thing, type_):
    a, b = select(k="a.type_id").from_(a=thing), select(k="b.id").from_(b=type_)
    assert rows(a.union(b)()) == [(1,), (2,)]
    assert len(rows(a.union_all(b)())) == 5
    assert rows(a.union(b).where("k > 1").select(k2="k * 10")()) == [(20,)]
    assert rows(select(x="a.id").from_(a=thing).union_all(select(y="b.id").from_(b=type_)).where("x IS NULL")()) == [(None, 1), (None, 2)]
    counts = select(k="t.type_id", n="count(1)").from_(t=thing).group_by("t.type_id")
    assert rows(select(name="type.name", n="c.n").from_(type=type_).join(c=counts).on("c.k = type.id")()) == [("Mineral", 1), ("Vegetable", 2)]
    memo = counts.memoize
    twice = select(x="a.k", y="b.k").from_(a=memo, b=memo).where("a.k < b.k")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    release()
    assert "InMemoryTableScan" not in plan(memo())
    assert rows(twice()) == [(1, 2)] and plan(twice()).count("InMemoryTableScan") == 2
    derived = twice().filter("x = 1").select("y")  # the result itself is gone
    gc.collect()
    assert "InMemoryTableScan" in plan(derived.select("y")) and rows(derived) == [(2,)]
    release()
    assert "InMemoryTableScan" not in plan(derived.select("y")) and rows(derived.select("y")) == [(2,)]


def test_memoized_once(spark, thing):
    """A memoized sub-query runs once, whatever is built on the result."""
    calls = spark.sparkContext.accumulator(0)

    def count(x):
        calls.add(1)
        return x

    register("counted", F.udf(count, "int").asNondeterministic())
    memo = select(k="counted(cast(t.id AS int))").from_(t=thing).memoize
    out = select(x="a.k", y="b.k").from_(a=memo, b=memo).where("a.k = b.k")()
    gc.collect()
    assert out.filter("x > 0").select("x").count() == 3 and out.filter("y = 2").count() == 1
    assert calls.value == 3


def test_list_parameters(thing):
    q = select(n="t.name").from_(t=thing)
    assert rows(q.where("t.id IN (:ids)")(ids=[1, 3])) == [("Apple",), ("Cake",)]
    assert rows(q.where("t.name NOT IN (?)", ["Apple", "it's"])()) == [("Banana",), ("Cake",)]
    assert rows(q.where("t.id IN (:ids) OR t.id = 2")(ids=())) == [("Banana",)]
    assert rows(q.where("t.id in(:ids, 2)")(ids={1})) == [("Apple",), ("Banana",)]
    assert rows(q.where("array_contains(:ids, t.id)")(ids=[2])) == [("Banana",)]
    with pytest.raises(ParameterError):
        q.where("t.id NOT IN (:ids)")(ids=[])


def test_grouping_again(more):
    q = select(k="t.type_id", n="count(1)").from_(t=more).group_by("t.type_id").select(n="n", groups="count(1)", top="max(k)").group_by("n")
    assert rows(q()) == [(1, 2, 3), (2, 1, 1)]
    assert rows(q.where("groups > 1").select(t="top")()) == [(3,)]


def test_older_rule_of_right_and_full_joins(more, type_):
    lone = Store.rows([*TYPE, {"id": 9, "name": "Lone"}])
    on = "type.id = thing.type_id"
    named = select(t="thing.name", k="type.name")
    right = named.from_(thing=more).right_join(type=lone).on(on).on("type.id <> 9")
    left = named.from_(type=lone).left_join(thing=more).on(on).on("type.id <> 9")
    assert rows(right.compat()()) == rows(left.compat()()) == [("Apple", "Vegetable"), ("Banana", "Vegetable"), ("Cake", "Mineral")]
    assert (None, "Lone") in rows(right())
    within = named.from_(thing=more).right_join(type=lone).on(on).where("thing.id = 1")
    assert rows(within.compat()()) == sorted([("Apple", "Vegetable"), (None, "Mineral"), (None, "Lone")], key=repr) and rows(within()) == [("Apple", "Vegetable")]
    full = named.from_(thing=more).full_join(type=lone).on(on).on("thing.id < 4").on("type.id < 9")
    assert rows(full.compat()()) == [("Apple", "Vegetable"), ("Banana", "Vegetable"), ("Cake", "Mineral")]
    assert ("Pie", None) in rows(full()) and (None, "Lone") in rows(full())


def test_lateral(more, type_):
    """A sub-query reads the columns of relations before it."""
    heavier = select(name="x.name", more="x.calories - t.calories").from_(x=more).where("x.type_id = t.type_id AND x.calories > t.calories")
    q = select(n="t.name", m="h.name", d="h.more").from_(t=more).join(h=heavier)
    assert rows(q()) == [("Apple", "Banana", 10)]
    assert len(rows(select(n="t.name", m="h.name").from_(t=more).left_join(h=heavier)())) == 4
    assert rows(select(n="t.name", m="h.name").from_(t=more).join(h=heavier).on("h.more > :d")(d=10)) == []
    kinds = select(k="k.name").from_(k=type_).join(x=more).on("x.type_id = k.id AND x.id < t.id").where("k.id = t.type_id")
    assert rows(select(n="t.name", k="s.k").from_(t=more).join(s=kinds).where("t.id > :x")(x=0)) == [("Banana", "Vegetable")]
    for wrong in (
        lambda: select(n="t.name").from_(t=more).join(h=select(n="count(1)").from_(x=more).where("x.id = t.id").group_by("1"))(),
        lambda: select(n="t.name").from_(t=more).full_join(h=heavier)(), lambda: select(n="t.name").from_(t=more).join(h=heavier, k=type_)(),
    ):
        with pytest.raises(AliasError):
            wrong()


def test_lateral_items_read_both_sides(more, type_):
    """Items over both sides are worked out above the join: its rows are never crossed with the values that the items read."""

    def run(q, **params):
        df = q(**params)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        return rows(df)

    other = select(n="x.name", d="x.calories - t.calories", s="coalesce(x.calories, 0) + t.id").from_(x=more).where("x.type_id = t.type_id AND x.id <> t.id")
    assert run(select(t="t.name", n="o.n", d="o.d").from_(t=more).join(o=other)) == [("Apple", "Banana", 10), ("Banana", "Apple", -10)]
    assert run(select(t="t.name", d="o.d").from_(t=more).join(o=other).on("o.d > :d AND d < 11"), d=0) == [("Apple", 10)]
    left = select(t="t.name", n="o.n", s="o.s").from_(t=more).left_join(o=other)
    assert run(left) == [("Apple", "Banana", 106), ("Banana", "Apple", 97), ("Cake", None, None), ("Pie", None, None)]
    ended = [("Apple", "Banana", 106), ("Banana", None, None), ("Cake", None, None), ("Pie", None, None)]
    assert run(left.on("o.d > ?", 0).on("t.id < 3")) == run(left.on("o.d > 0 AND o.n = 'Banana'")) == ended
    # terms that could mean another column within the sub-query, and Columns, are joined on as they are
    assert rows(left.on("d > 0")()) == rows(left.on(F.col("o.d") > 0)()) == rows(left.on(lambda p: F.col("o.d") > p.d)(d=0)) == ended
    # names are the sub-query's own first: the alias k, the bare name
    own = select(v="k.name || name || t.name").from_(k=type_).where("k.id = t.type_id")
    assert run(select(a="k.name", v="h.v").from_(t=more).join(k=type_).on("k.id = t.id").join(h=own)) == [("Mineral", "VegetableVegetableBanana"), ("Vegetable", "VegetableVegetableApple")]
    row = select(v="to_json(named_struct('k', k, 't', t.id))", w="transform(array(k.id), id -> id + t.id)").from_(k=type_).where("k.id = t.type_id")
    assert run(select("h").from_(t=more).join(h=row).where("t.id = 3")) == [('{"k":{"id":2,"name":"Mineral"},"t":3}', [5])]
    nested = select(v="g.v + t.id").from_(k=type_).left_join(g=select(v="x.calories * k.id").from_(x=more).where("x.type_id = k.id")).where("k.id = t.type_id")
    assert run(select(t="t.id", v="sum(h.v)").from_(t=more).left_join(h=nested).group_by("t.id")) == [(1, 202), (2, 204), (3, 473), (4, 0)]
    register("upper", "upper({0} || '!')")  # put in once
    loud = select(v="upper(k.name || t.name)").from_(k=type_).where("k.id = t.type_id")
    try:
        assert run(select(v="h.v").from_(t=more).left_join(h=loud).on("upper(h.v) LIKE '%CAKE!!'")) == [("MINERALCAKE!",), (None,), (None,), (None,)]
    finally:
        del MACROS["upper"]
    absent = select(v="CASE WHEN missing(k) THEN t.name ELSE k.name END").from_(x=more).left_join(k=type_).on("k.id = x.type_id").where("x.id = t.id")
    assert run(select(v="h.v").from_(t=more).join(h=absent)) == [("Mineral",), ("Pie",), ("Vegetable",), ("Vegetable",)]


def test_functions(spark, thing):
    register("twice", "({0}) * 2")
    register("shout", F.udf(lambda s: s and s + "!", "string"))
    assert rows(select(v="twice(t.id + 1)", s="shout(t.name)").from_(t=thing).where("twice(t.id) = 4")()) == [(6, "Banana!")]
    one = lambda text: select(v=text).from_(t=thing).where("t.id = 1")().first().v
    assert [one(f"cmp({a}, {b})") for a, b in ((1, 2), (2, 2), (3, 2))] == [-1, 0, 1]
    assert [one(f"truthy({x})") for x in ("0", "1", "''", "'0'", "NULL", "double('NaN')", "0.0D", "true", "false")] == [False, True, False, True, False, False, False, True, False]
    assert one("round_half_up(-2.5)") == -2
    with pytest.raises(QueryError):
        register("sum", "{0}")


def test_errors(thing, type_):
    base = select(n="a.name").from_(a=thing)
    for wrong in (
        lambda: base.select(x="a.id"), lambda: base.from_(b=thing), lambda: base.join(a=thing), lambda: base.on("a.id = 1"), lambda: base.into(thing),
        lambda: base.returning("this"), lambda: select(n="count(a.id)").from_(a=thing).group_by("a.id").group_by("a.id"), lambda: select(n="a.b").from_(a=3),
        lambda: select(n="1")(), lambda: base.finalize().where("a.id = 1"), lambda: base.union(5),
    ):
        with pytest.raises(QueryError):
            wrong()
    for wrong in (lambda: base.join({"$$x": type_}), lambda: select(n="b.name").from_(a=thing)(), lambda: base.where("zzz.id = 1")()):
        with pytest.raises(AliasError):
            wrong()
    with pytest.raises(AggregateError):
        base.where("sum(a.id) > 1")
    with pytest.raises(AggregateError):
        select(n="count()").from_(a=thing).group_by("1")()
    with pytest.raises(AggregateError):
        select(n="sum(max(a.id))").from_(a=thing).group_by("1")()
    with pytest.raises(QueryError, match="mixes"):
        Store.rows([{"x": 1}, {"x": "a"}])


def test_tree_collect_and_stream(spark, thing):
    q = select(n="a.name").from_(a=thing).where("a.id > :x").order_by("a.id").desc
    t = q.tree()
    assert t["kind"] == "select" and {"where": "a.id > :x"} in t["clauses"] and t["clauses"][-1]["descending"]
    assert [r.n for r in q.collect(x=1)] == ["Cake", "Banana"]
    seen = []
    q.for_each(lambda r: seen.append(r.n), x=1)
    assert seen == ["Cake", "Banana"]


def test_partial_and_final(thing):
    q = select(n="a.name").from_(a=thing).where("a.id = :x OR a.id = :y").partial(x=1)
    assert rows(q(y=2)) == [("Apple",), ("Banana",)] and rows(q(x=3, y=3)) == [("Cake",)]
    assert rows(select(n="s.n").from_(s=q)(y=3)) == [("Apple",), ("Cake",)]
    final = q.order_by("a.id").finalize()
    for change in (lambda: final.desc, lambda: final.memoize, lambda: final.compat(), lambda: final.where("1 = 1"), lambda: final.union(q)):
        with pytest.raises(QueryError, match="final"):
            change()
    assert len(rows(final(y=1))) == 1


def test_streaming_source(spark, tmp_path):
    from quillspark.streaming import start

    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = start(select(v="s.id * 2").from_(s=Store.dataframe(stream)).where("s.id > :x"), "memory", "out_test", params={"x": 2})
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("out_test")) == [(6,), (8,)]


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s").write.parquet(str(tmp_path / "t"))
    t = Store.parquet(str(tmp_path / "t"))
    plan = select(id="t.id").from_(t=t).where("t.k = :k AND t.id > ?", 10)(k=3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "GreaterThan(id,10)" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan
