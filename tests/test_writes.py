import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillspark import QueryError, Range, Store, delete_from, insert, select, transaction, update, upsert
from quillspark.errors import KeyError_, TransactionError
from quillspark.sources import ranges

BOOKS = [
    {"isbn": 123456, "title": "Quarry Memories", "author": "Fred"},
    {"isbn": 234567, "title": "Water Buffaloes", "author": "Fred"},
    {"isbn": 345678, "title": "Bedrock Nights", "author": "Barney"},
]
ITEMS = [(1, 123456, 3), (1, 234567, 4), (1, 345678, 5), (2, 123456, 1), (2, 234567, 2)]


@pytest.fixture
def book(spark):
    return Store.rows(BOOKS, key="isbn", schema="isbn bigint, title string, author string")


@pytest.fixture
def item(spark):
    return Store.rows([dict(zip(("storeId", "isbn", "quantity"), r, strict=True)) for r in ITEMS], key=["storeId", "isbn"])


def titles(book, txn=None):
    return [r[0] for r in rows(select(t="b.title").from_(b=book)(txn=txn))]


def test_insert(book, item):
    new = insert(isbn=":isbn", title=":title", author="'O''Neil'").into(book)
    assert new(isbn=9781558603929, title="Database").first()["count"] == 1
    assert "Database" in titles(book) and len(titles(book)) == 4
    with pytest.raises(KeyError_):
        new(isbn=9781558603929, title="Again")
    assert len(titles(book)) == 4
    got = insert("b.*").into(item).from_(b=[{"storeId": 3, "isbn": 1, "quantity": 1}]).returning(q="this.quantity")()
    assert rows(got) == [(1,)]
    with pytest.raises(KeyError_):
        insert("b.*").into(item).from_(b=[{"storeId": 2, "isbn": 123456, "quantity": 1}])()
    with pytest.raises(KeyError_):
        insert("b.*").into(item).from_(b=[{"storeId": 7, "isbn": 7, "quantity": 1}, {"storeId": 7, "isbn": 7, "quantity": 2}])()
    with pytest.raises(KeyError_):
        insert(title="'x'").into(book)()
    assert insert("b.*").into(book).from_(b=book).where("b.isbn < 0")().first()["count"] == 0


def test_generated_keys(spark):
    store = Store.rows([{"title": "A"}, {"title": "B"}, None, {"title": "C"}])
    insert(title="s.title").into(store).from_(s=[{"title": "D"}, {"title": "E"}])()
    assert sorted(r["_pk"] for r in store.df.collect()) == [0, 1, 3, 4, 5]
    insert(title="'K'", _pk="10").into(store)()
    insert(title="'L'").into(store)()
    assert {r["title"]: r["_pk"] for r in store.df.collect()}["L"] == 11
    assert "_pk" not in insert(title="'M'").into(store).returning("*")().columns
    named = Store.rows({"a": {"title": "A"}, "b": {"title": "B"}})
    upsert(title="'new'", _pk="'b'").into(named)()
    assert rows(named.df.select("_pk", "title")) == [("a", "A"), ("b", "new")]
    with pytest.raises(KeyError_):
        insert(title="'x'").into(named)()
    auto = Store.rows([{"id": 5, "n": "x"}], key="id", auto=True)
    assert rows(insert(n="s.n").into(auto).from_(s=[{"n": "y"}, {"n": "z"}]).returning(id="this.id")()) == [(6,), (7,)]


def test_upsert_update_delete(book, item):
    assert upsert(isbn="234567", title="'Changed'", author="'Wilma'").into(book)().first()["count"] == 1
    assert titles(book) == ["Bedrock Nights", "Changed", "Quarry Memories"]
    assert update(title=":t").into(book).where("this.isbn = :i")(t="New", i=123456).first()["count"] == 1
    assert rows(update(author="upper(this.author)").into(book).returning(t="this.title", a="this.author")()) == [("Bedrock Nights", "BARNEY"), ("Changed", "WILMA"), ("New", "FRED")]
    one = update(quantity="this.quantity + b.n").into(item).join(b=[{"i": 234567, "n": 10}]).on("b.i = this.isbn")
    assert one().first()["count"] == 2
    assert rows(select(q="i.quantity").from_(i=item).where("i.isbn = 234567")()) == [(12,), (14,)]
    with pytest.raises(QueryError, match="several rows"):
        update(quantity="b.n").into(item).join(b=[{"i": 234567, "n": 1}, {"i": 234567, "n": 2}]).on("b.i = this.isbn")()
    with pytest.raises(QueryError, match="key"):
        update(isbn="1").into(book)()
    assert delete_from(book).where("this.isbn = 234567")().first()["count"] == 1
    assert delete_from(book).where("this.isbn = 999")().first()["count"] == 0
    assert rows(delete_from(item).join(b=book).on("b.isbn = this.isbn").where("b.title = 'New'").returning(s="this.storeId")()) == [(1,), (2,)]
    assert delete_from(book)().first()["count"] == 2
    assert titles(book) == []


def test_transactions(book):
    t = transaction()
    update(title="'Z'").into(book).where("this.isbn = 123456")(txn=t)
    assert "Z" in titles(book, t) and "Z" not in titles(book)
    t.commit()
    assert "Z" in titles(book)
    for wrong in (t.commit, t.abort, lambda: select("b").from_(b=book)(txn=t), lambda: delete_from(book)(txn=t)):
        with pytest.raises(TransactionError):
            wrong()
    t = transaction()
    delete_from(book)(txn=t)
    t.abort()
    assert len(titles(book)) == 3
    with pytest.raises(ZeroDivisionError), transaction() as t:
        delete_from(book)(txn=t)
        1 / 0  # noqa: B018
    assert t.state == "aborted" and len(titles(book)) == 3
    t = transaction()
    with pytest.raises(KeyError_):
        insert("b").into(book).from_(b=book)(txn=t)
    assert t.state == "aborted"
    with transaction() as t:
        delete_from(book).where("this.isbn = 123456")(txn=t)
        assert select("b").from_(b=book).union_all(book)(txn=t).count() == 4  # both sides see the transaction's rows
        t.abort()
    with transaction() as t:
        insert(isbn="1", title="'one'").into(book)(txn=t)
        update(title="concat(this.title, '!')").into(book).where("this.isbn = 1")(txn=t)
        insert(isbn="b.isbn + 1000000", title="b.title").into(book).from_(b=book)(txn=t)  # reads all before it writes
    assert titles(book).count("one!") == 2 and len(titles(book)) == 8


def test_parquet_snapshots(spark, tmp_path):
    path = str(tmp_path / "books")
    spark.createDataFrame([(b["isbn"], b["title"]) for b in BOOKS], "isbn long, title string").write.parquet(path)
    store = Store.parquet(path, key="isbn")
    delete_from(store).where("this.isbn = 123456")()
    upsert(isbn="1", title="'one'").into(store)()
    again = Store.parquet(path, key="isbn")
    assert rows(again.df.select("isbn")) == [(1,), (234567,), (345678,)]
    assert spark.read.parquet(path).count() == 3  # the original stays
    with pytest.raises(KeyError_):
        insert(isbn="1", title="'x'").into(again)()
    assert rows(Store.parquet(path, key="isbn").df.select("isbn")) == [(1,), (234567,), (345678,)]


def sizes(path):
    return {str(f): f.stat().st_size for f in path.parent.glob(f"{path.name}.snapshots/data/*/part-*")}


def test_parquet_changes_files_they_touch(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(20_000).selectExpr("id", "repeat(cast(id AS string), 5) AS s").repartitionByRange(8, "id").write.parquet(str(path))
    store = Store.parquet(str(path), key="id")
    insert(id="-1L", s="'new'").into(store)()
    first = sizes(path)
    assert len(first) == 1 and sum(first.values()) < 2000  # an insert writes its rows alone
    update(s="'changed'").into(store).where("this.id = 19999")()
    second = {f: n for f, n in sizes(path).items() if f not in first}
    assert sum(second.values()) < 100_000 and len(store._base.files) == 9  # of the eight files one was rewritten
    delete_from(store).where("this.id < 10")()
    again = Store.parquet(str(path), key="id")
    assert again.df.agg(F.count("*"), F.min("id"), F.sum(F.expr("cast(s = 'changed' AS int)"))).first() == (19_990, 10, 1)
    plan = again.df.filter("id = 15000")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,15000)" in plan
    assert store.vacuum() >= 3 and Store.parquet(str(path), key="id").df.count() == 19_990
    delete_from(store)()
    assert Store.parquet(str(path), key="id").df.count() == 0
    insert(id="7L", s="'x'").into(store)()
    assert rows(Store.parquet(str(path), key="id").df) == [(7, "x")]


def test_parquet_conflicts(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string").write.parquet(path)
    one, two = Store.parquet(path, key="id"), Store.parquet(path, key="id")
    insert(id="3L", s="'one'").into(one)()
    with pytest.raises(TransactionError, match="another writer"):
        insert(id="4L", s="'two'").into(two)()
    insert(id="4L", s="'two'").into(two.refresh())()
    assert rows(Store.parquet(path, key="id").df) == [(1, "a"), (2, "b"), (3, "one"), (4, "two")]


def test_parquet_stores_commit_together(spark, tmp_path, monkeypatch):
    from quillspark.sources import snapshots

    paths = [str(tmp_path / n) for n in "ab"]
    for p in paths:
        spark.createDataFrame([(1, "x")], "id long, s string").write.parquet(p)
    read = lambda: [Store.parquet(p, key="id").df.count() for p in paths]
    a, b, late = Store.parquet(paths[0], key="id"), Store.parquet(paths[1], key="id"), Store.parquet(paths[1], key="id")
    with transaction() as t:
        insert(id="2L", s="'y'").into(a)(txn=t)
        insert(id="2L", s="'y'").into(b)(txn=t)
        insert(id="3L", s="'y'").into(b)(txn=t)
        delete_from(b).where("this.id = 2")(txn=t)
    assert read() == [2, 2] and rows(Store.parquet(paths[1], key="id").df.select("id")) == [(1,), (3,)]
    with pytest.raises(TransactionError), transaction() as t:  # the second store has moved on: the first keeps its state too
        insert(id="9L", s="'y'").into(a)(txn=t)
        insert(id="9L", s="'y'").into(late)(txn=t)
    assert read() == [2, 2]
    insert(id="5L", s="'y'").into(a.refresh())()
    assert read() == [3, 2]
    # a writer that dies before its record exists leaves entries that don't count, and others may go on
    real = snapshots.create_once
    monkeypatch.setattr(snapshots, "create_once", lambda spark, path, text: real(spark, path, text) if text != "committed" else 1 / 0)
    with pytest.raises(ZeroDivisionError), transaction() as t:
        insert(id="6L", s="'y'").into(a)(txn=t)
        insert(id="6L", s="'y'").into(b.refresh())(txn=t)
    monkeypatch.undo()
    assert read() == [3, 2]
    insert(id="7L", s="'y'").into(a.refresh())()
    assert read() == [4, 2]


def test_keys_are_not_given_twice(spark, tmp_path):
    store = Store.rows([{"t": "A"}, {"t": "B"}])
    delete_from(store).where("this.t = 'B'")()
    insert(t="'C'").into(store)()
    insert(t="'D'").into(store)()
    delete_from(store).where("this.t = 'D'")()
    insert(t="'E'").into(store)()
    assert {r["t"]: r["_pk"] for r in store.df.collect()} == {"A": 0, "C": 2, "E": 4}
    auto = Store.rows([{"id": 5, "n": "x"}, {"id": 7, "n": "y"}], key="id", auto=True)
    delete_from(auto).where("this.id = 7")()
    assert rows(insert(n="'z'").into(auto).returning(id="this.id")()) == [(8,)]
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string").write.parquet(path)
    delete_from(Store.parquet(path, key="id", auto=True)).where("this.id = 2")()
    kept = Store.parquet(path, key="id", auto=True)
    insert(s="'c'").into(kept)()
    assert rows(Store.parquet(path, key="id").df) == [(1, "a"), (3, "c")]


def test_nested_key_and_tables(spark):
    store = Store.rows([{"a": {"b": 1}, "v": "x"}, {"a": {"b": 2}, "v": "y"}], key="a.b")
    assert update(v="'z'").into(store).where("this.a.b = 2")().first()["count"] == 1
    assert delete_from(store).where("this.a.b = 1")().first()["count"] == 1
    assert rows(store.df.select("v")) == [("z",)]
    store.df.createOrReplaceTempView("nested_view")
    assert select("t.v").from_(t=Store.table("nested_view"))().count() == 1


def test_ranges_match_plain_python(spark):
    import random

    r = random.Random(3)
    values = list(range(-3, 12))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x int")
    for _ in range(25):
        def one():
            a, b = r.choice([None, *values]), r.choice([None, *values])
            return Range(a, b, r.random() < 0.5, r.random() < 0.5)

        some = [one() for _ in range(r.randint(1, 3))]
        got = lambda c: sorted(x.x for x in df.filter(c).collect())
        assert got(ranges.union(F.col("x"), some)) == [v for v in values if any(s.includes(v) for s in some)]
        assert got(ranges.intersection(F.col("x"), some)) == [v for v in values if all(s.includes(v) for s in some)]
        assert all(not any(s.includes(v) for v in values) for s in some if s.empty)
    assert df.filter(ranges.composite([(F.col("x"), Range.equal(3)), (F.col("x") + 1, Range(2, 9))])).count() == 1
