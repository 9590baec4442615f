"""The registered statements over the driver's tables, each through the builder, with the same statement in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AggregateError, AliasError, ParameterError, QueryError, TransactionError
from ..functions import register, register_aggregate
from ..sources import ranges
from ..sources.ranges import Range
from ..sources.scratch import Scratch
from ..sources.store import Store
from .query import Query, delete_from, insert, select, update, upsert
from .transaction import transaction

register_aggregate("xor_all", F.bit_xor)


class Tables:
    """Stores over the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> Store:
        return Store.dataframe(self._spark.read.parquet(f"{self._folder}/{name}.parquet"), name=name)

    def copy(self, name: str, key, auto: bool = False) -> Store:
        """A Parquet store over a copy of a table, which statements may change."""
        scratch = Scratch(self._spark, name)
        self._spark.read.parquet(f"{self._folder}/{name}.parquet").write.parquet(f"{scratch.path}/{name}")
        return Store.parquet(f"{scratch.path}/{name}", key, auto, name)

    def rows(self, data: list, schema: str) -> DataFrame:
        return self._spark.createDataFrame(data, schema)

    def keyed(self, name: str, key) -> Store:
        return Store.dataframe(self._spark.read.parquet(f"{self._folder}/{name}.parquet"), key, name=name)


Statement = Callable[[Tables], DataFrame]
CATALOGUE: dict[str, tuple[Statement, str]] = {}


def entry(name: str, sql: str):
    def add(f: Statement) -> Statement:
        CATALOGUE[name] = (f, sql)
        return f

    return add


@entry("scan_project", "select n_nationkey, n_name, n_regionkey from nation")
def _(t):
    return select("n.*").from_(n=t.nation)()


@entry("project_expr", "select o_orderkey, o_totalprice * 2 + 1 as v, upper(o_orderpriority) as prio from orders")
def _(t):
    return select(o_orderkey="o.o_orderkey", v="o.o_totalprice * 2 + 1", prio="upper(o.o_orderpriority)").from_(o=t.orders)()


@entry("filter_eq_param", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def _(t):
    return select("o.o_orderkey", "o.o_totalprice").from_(o=t.orders).where("o.o_orderstatus == :status")(status="F")


@entry("filter_range", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 10 and l_quantity < 20")
def _(t):
    return select("l.l_orderkey", "l.l_linenumber", "l.l_quantity").from_(l=t.lineitem).where("l.l_quantity >= ? AND l.l_quantity < ?", 10, 20)()


@entry("filter_range_union", "select p_partkey, p_size from part where p_size = 1 or p_size = 7 or p_size > 45")
def _(t):
    return select("p.p_partkey", "p.p_size").from_(p=t.part).where("p.p_size = 1 OR p.p_size = 7 OR p.p_size > 45")()


@entry("filter_range_complement", "select p_partkey, p_size from part where not (p_size >= 5 and p_size <= 40)")
def _(t):
    return select("p.p_partkey", "p.p_size").from_(p=t.part).where("NOT (p.p_size >= 5 AND p.p_size <= 40)")()


@entry("filter_in_list", "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def _(t):
    return select("c.c_custkey", "c.c_mktsegment").from_(c=t.customer).where("array_contains(:segments, c.c_mktsegment)")(segments=["BUILDING", "MACHINERY"])


@entry("filter_callable", "select p_partkey from part where p_size > 30 and p_retailprice < 1500")
def _(t):
    return select(p_partkey="p.p_partkey").from_(p=t.part).where(lambda p: F.col("p.p_size") > p.size).where(F.col("p.p_retailprice") < 1500)(size=30)


@entry("cross_join", "select r.r_name, n.n_name from region r cross join nation n")
def _(t):
    return select("r.r_name", "n.n_name").from_(r=t.region, n=t.nation)()


@entry("inner_join_on", "select n.n_name, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey")
def _(t):
    return select("n.n_name", "r.r_name").from_(n=t.nation).join(r=t.region).on("n.n_regionkey = r.r_regionkey")()


@entry("inner_join_chain_where", "select c.c_name, o.o_orderkey, l.l_linenumber from customer c join orders o on o.o_custkey = c.c_custkey join lineitem l on l.l_orderkey = o.o_orderkey where c.c_mktsegment = 'BUILDING' and l.l_quantity > 45")
def _(t):
    return (
        select("c.c_name", "o.o_orderkey", "l.l_linenumber").from_(c=t.customer)
        .join(o=t.orders).on("o.o_custkey = c.c_custkey").join(l=t.lineitem).on("l.l_orderkey = o.o_orderkey")
        .where("c.c_mktsegment = :segment").where("l.l_quantity > 45")(segment="BUILDING")
    )


@entry("implicit_join_where", "select s.s_name, n.n_name, r.r_name from supplier s, nation n, region r where s.s_nationkey = n.n_nationkey and n.n_regionkey = r.r_regionkey")
def _(t):
    return select("s.s_name", "n.n_name", "r.r_name").from_(s=t.supplier, n=t.nation, r=t.region).where("s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey")()


@entry("self_join", "select a.n_name as n1, b.n_name as n2 from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def _(t):
    nation = t.nation
    return select(n1="a.n_name", n2="b.n_name").from_(a=nation).join(b=nation).on("a.n_regionkey = b.n_regionkey").on("a.n_nationkey < b.n_nationkey")()


@entry("theta_join", "select s.s_suppkey, c.c_custkey from supplier s join customer c on s.s_nationkey = c.c_nationkey and s.s_acctbal > c.c_acctbal")
def _(t):
    return select("s.s_suppkey", "c.c_custkey").from_(s=t.supplier).join(c=t.customer).on("s.s_nationkey = c.c_nationkey AND s.s_acctbal > c.c_acctbal")()


def _dear(t: Tables, price: int) -> Query:
    return select("x.*").from_(x=t.orders).where("x.o_totalprice > ?", price)


@entry("left_join", "select c.c_custkey, o.o_orderkey from customer c left join (select * from orders where o_totalprice > 450000) o on o.o_custkey = c.c_custkey")
def _(t):
    return select("c.c_custkey", "o.o_orderkey").from_(c=t.customer).left_join(o=_dear(t, 450000)).on("o.o_custkey = c.c_custkey")()


@entry("left_join_left_only_on", "select c.c_custkey, o.o_orderkey from (select * from customer where c_acctbal > 0) c left join orders o on o.o_custkey = c.c_custkey")
def _(t):
    # the older placement: a predicate of ON over the left side filters the left rows
    return select("c.c_custkey", "o.o_orderkey").from_(c=t.customer).left_join(o=t.orders).on("o.o_custkey = c.c_custkey AND c.c_acctbal > 0").compat()()


@entry("left_join_on_ansi", "select c.c_custkey, o.o_orderkey from customer c left join orders o on o.o_custkey = c.c_custkey and c.c_acctbal > 0")
def _(t):
    return select("c.c_custkey", "o.o_orderkey").from_(c=t.customer).left_join(o=t.orders).on("o.o_custkey = c.c_custkey AND c.c_acctbal > 0")()


@entry("left_join_where_missing", "select c.c_custkey from customer c left join (select * from orders where o_totalprice > 450000) o on o.o_custkey = c.c_custkey where o.o_orderkey is null")
def _(t):
    return select(c_custkey="c.c_custkey").from_(c=t.customer).left_join(o=_dear(t, 450000)).on("o.o_custkey = c.c_custkey").where("missing(o)")()


@entry("left_join_pair", "select c.c_custkey, n.n_name, r.r_name from customer c left join (nation n cross join region r) on c.c_nationkey = n.n_nationkey and n.n_regionkey = r.r_regionkey and r.r_name = 'ASIA'")
def _(t):
    return select("c.c_custkey", "n.n_name", "r.r_name").from_(c=t.customer).left_join(n=t.nation, r=t.region).on("c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'")()


@entry("right_join", "select c.c_custkey, o.o_orderkey from (select * from orders where o_totalprice > 450000) o right join customer c on o.o_custkey = c.c_custkey")
def _(t):
    return select("c.c_custkey", "o.o_orderkey").from_(o=_dear(t, 450000)).right_join(c=t.customer).on("o.o_custkey = c.c_custkey")()


@entry("full_join", "select c.c_custkey, o.o_orderkey from (select * from customer where c_acctbal > 8000) c full join (select * from orders where o_totalprice > 480000) o on o.o_custkey = c.c_custkey")
def _(t):
    rich = select("x.*").from_(x=t.customer).where("x.c_acctbal > 8000")
    return select("c.c_custkey", "o.o_orderkey").from_(c=rich).full_join(o=_dear(t, 480000)).on("o.o_custkey = c.c_custkey")()


@entry("full_join_ordered", "select c.c_name as name, o.o_orderkey as order_id from (select * from customer where c_acctbal > 8000) c full join (select * from orders where o_totalprice > 480000) o on o.o_custkey = c.c_custkey order by c.c_name asc nulls last")
def _(t):
    rich = select("x.*").from_(x=t.customer).where("x.c_acctbal > 8000")
    return select(name="c.c_name", order_id="o.o_orderkey").from_(c=rich).full_join(o=_dear(t, 480000)).on("o.o_custkey = c.c_custkey").order_by("c.c_name").asc()


@entry("anti_join", "select c.c_custkey, c.c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)")
def _(t):
    return select("c.c_custkey", "c.c_name").from_(c=t.customer).anti_join(o=t.orders).on("o.o_custkey = c.c_custkey AND o.o_totalprice > 400000")()


@entry("left_join_natural", "select o.o_orderkey, l.l_linenumber, l.l_quantity from orders o left join lineitem l on l.l_orderkey = o.o_orderkey")
def _(t):
    return select("o.o_orderkey", "l.l_linenumber", "l.l_quantity").from_(o=t.orders).left_join(l=t.lineitem).on("l.l_orderkey = o.o_orderkey")()


@entry("anti_join_natural", "select d.doc_id, d.lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def _(t):
    return select("d.doc_id", "d.lang").from_(d=t.documents).anti_join(l=t.labels).on("l.doc_id = d.doc_id")()


@entry("group_aggregates", "select l_returnflag, l_linestatus, count(l_quantity) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as s, round(avg(l_quantity), 6) as a, min(l_shipdate) as mn, max(l_extendedprice) as mx from lineitem group by l_returnflag, l_linestatus")
def _(t):
    return select(
        l_returnflag="l.l_returnflag", l_linestatus="l.l_linestatus", n="count(l.l_quantity)", s="cast(sum(cast(l.l_quantity AS decimal(18,2))) AS double)",
        a="round(avg(l.l_quantity), 6)", mn="min(l.l_shipdate)", mx="max(l.l_extendedprice)",
    ).from_(l=t.lineitem).group_by("l.l_returnflag", "l.l_linestatus")()


@entry("group_count_skips_missing", "select c.c_mktsegment, count(o.o_orderkey) as n, count(1) as rows_ from customer c left join (select * from orders where o_totalprice > 450000) o on o.o_custkey = c.c_custkey group by c.c_mktsegment")
def _(t):
    return (
        select(c_mktsegment="c.c_mktsegment", n="count(o.o_orderkey)", rows_="count(1)").from_(c=t.customer)
        .left_join(o=_dear(t, 450000)).on("o.o_custkey = c.c_custkey").group_by("c.c_mktsegment")()
    )


@entry("group_sum_empty_is_zero", "select c.c_nationkey, coalesce(cast(sum(cast(o.o_totalprice as decimal(18,2))) as double), 0.0) as s from customer c left join (select * from orders where o_totalprice > 495000) o on o.o_custkey = c.c_custkey group by c.c_nationkey")
def _(t):
    return (
        select(c_nationkey="c.c_nationkey", s="cast(sum(cast(o.o_totalprice AS decimal(18,2))) AS double)").from_(c=t.customer)
        .left_join(o=_dear(t, 495000)).on("o.o_custkey = c.c_custkey").group_by("c.c_nationkey")()
    )


@entry("group_expr_key", "select cast(year(o_orderdate) as bigint) as y, count(1) as n from orders group by year(o_orderdate)")
def _(t):
    return select(y="cast(year(o.o_orderdate) AS bigint)", n="count(1)").from_(o=t.orders).group_by("year(o.o_orderdate)")()


@entry("group_aggregate_expression", "select o_custkey, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice), 4) as a from orders group by o_custkey")
def _(t):
    return select(o_custkey="o.o_custkey", a="round(cast(sum(cast(o.o_totalprice AS decimal(18,2))) AS double) / count(o.o_totalprice), 4)").from_(o=t.orders).group_by("o.o_custkey")()


@entry("group_constant_key", "select count(1) as n, min(o_totalprice) as mn, max(o_totalprice) as mx from orders having count(*) > 0")
def _(t):
    return select(n="count(1)", mn="min(o.o_totalprice)", mx="max(o.o_totalprice)").from_(o=t.orders).group_by("1")()


@entry("group_constant_key_empty", "select count(1) as n from orders where o_totalprice < 0 having count(*) > 0")
def _(t):
    return select(n="count(1)").from_(o=t.orders).where("o.o_totalprice < 0").group_by("1")()


@entry("having", "select o_custkey, count(1) as n from orders group by o_custkey having count(1) >= 15")
def _(t):
    return select(o_custkey="o.o_custkey", n="count(1)").from_(o=t.orders).group_by("o.o_custkey").where("n >= :least")(least=15)


@entry("post_aggregate_project", "select t.o_custkey, t.mx - t.mn as spread from (select o_custkey, max(o_totalprice) as mx, min(o_totalprice) as mn from orders group by o_custkey) t")
def _(t):
    return (
        select(o_custkey="o.o_custkey", mx="max(o.o_totalprice)", mn="min(o.o_totalprice)").from_(o=t.orders)
        .group_by("o.o_custkey").select(o_custkey="o_custkey", spread="mx - mn")()
    )


@entry("order_by_multi", "select c_custkey, c_nationkey, c_acctbal from customer order by c_nationkey asc nulls last, c_acctbal desc nulls last")
def _(t):
    return select("c.c_custkey", "c.c_nationkey", "c.c_acctbal").from_(c=t.customer).order_by("c.c_nationkey").order_by("c.c_acctbal").desc()


@entry("order_by_nulls", "select c.c_custkey, o.o_totalprice from customer c left join (select * from orders where o_totalprice > 450000) o on o.o_custkey = c.c_custkey order by o.o_totalprice desc nulls first")
def _(t):
    return (
        select("c.c_custkey", "o.o_totalprice").from_(c=t.customer).left_join(o=_dear(t, 450000)).on("o.o_custkey = c.c_custkey")
        .order_by("o.o_totalprice").desc.nulls_first()
    )


@entry("order_by_expression", "select p_partkey from part order by p_size % 7 desc nulls last, p_partkey asc nulls last")
def _(t):
    return select(p_partkey="p.p_partkey").from_(p=t.part).order_by("p.p_size % :m").desc.order_by("p.p_partkey")(m=7)


@entry("union_distinct", "select c_nationkey as k from customer union select s_nationkey as k from supplier")
def _(t):
    return select(k="c.c_nationkey").from_(c=t.customer).union(select(k="s.s_nationkey").from_(s=t.supplier))()


@entry("union_all", "select c_nationkey as k from customer union all select s_nationkey as k from supplier")
def _(t):
    return select(k="c.c_nationkey").from_(c=t.customer).union_all(select(k="s.s_nationkey").from_(s=t.supplier))()


@entry("union_by_name", "select c_nationkey as k, c_name as n, null as m from customer union all select s_nationkey as k, null as n, s_name as m from supplier")
def _(t):
    return select(k="c.c_nationkey", n="c.c_name").from_(c=t.customer).union_all(select(m="s.s_name", k="s.s_nationkey").from_(s=t.supplier))()


@entry("union_then_filter", "select k from (select c_nationkey as k from customer union select s_nationkey as k from supplier) u where k > 10")
def _(t):
    return select(k="c.c_nationkey").from_(c=t.customer).union(select(k="s.s_nationkey").from_(s=t.supplier)).where("k > 10").order_by("k")()


@entry("from_subquery", "select n.n_name, t.n from nation n join (select c_nationkey as k, count(1) as n from customer group by c_nationkey) t on t.k = n.n_nationkey")
def _(t):
    counts = select(k="c.c_nationkey", n="count(1)").from_(c=t.customer).group_by("c.c_nationkey")
    return select(n_name="n.n_name", n="t.n").from_(n=t.nation).join(t=counts).on("t.k = n.n_nationkey")()


@entry("memoized_subquery_twice", "with t as (select c_nationkey as k, count(1) as n from customer group by c_nationkey) select a.k as k1, b.k as k2 from t a join t b on a.n = b.n and a.k < b.k")
def _(t):
    counts = select(k="c.c_nationkey", n="count(1)").from_(c=t.customer).group_by("c.c_nationkey").memoize
    return select(k1="a.k", k2="b.k").from_(a=counts, b=counts).where("a.n = b.n AND a.k < b.k")()


@entry("semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def _(t):
    owners = select(k="o.o_custkey").from_(o=t.orders).where("o.o_totalprice > 450000")
    return select(c_custkey="c.c_custkey").from_(c=t.customer).join(o=owners.union(owners).memoize).on("o.k = c.c_custkey")()


@entry("string_functions", "select p_partkey, lower(p_name) as lo, cast(length(p_brand) as bigint) as len, substring(p_type, 1, 3) as pre, replace(p_brand, '#', '-') as rep, concat(p_brand, '/', p_type) as cc from part")
def _(t):
    return select(p_partkey="p.p_partkey", lo="lower(p.p_name)", len="cast(length(p.p_brand) AS bigint)", pre="substring(p.p_type, 1, 3)", rep="replace(p.p_brand, '#', '-')", cc="concat(p.p_brand, '/', p.p_type)").from_(p=t.part)()


@entry("math_functions", "select c_custkey, abs(c_acctbal) as a, cast(floor(c_acctbal) as bigint) as f, cast(ceil(c_acctbal) as bigint) as c, round(sqrt(abs(c_acctbal)), 6) as r, round(sin(c_acctbal), 6) as s from customer")
def _(t):
    return select(c_custkey="c.c_custkey", a="abs(c.c_acctbal)", f="floor(c.c_acctbal)", c="ceil(c.c_acctbal)", r="round(sqrt(abs(c.c_acctbal)), 6)", s="round(sin(c.c_acctbal), 6)").from_(c=t.customer)()


@entry("date_functions", "select event_id, year(ts) as y, month(ts) as m, day(ts) as d, hour(ts) as h from events where ts >= timestamp '2024-01-15 00:00:00'")
def _(t):
    return select(event_id="e.event_id", y="cast(year(e.ts) AS bigint)", m="cast(month(e.ts) AS bigint)", d="cast(day(e.ts) AS bigint)", h="cast(hour(e.ts) AS bigint)").from_(e=t.events).where("e.ts >= timestamp_ntz '2024-01-15 00:00:00'")()


@entry("json_function", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(t):
    return select(event_id="e.event_id", k="try_cast(get_json_object(e.props, '$.k') AS bigint)").from_(e=t.events)()


@entry("array_functions", "select vec_id, cast(len(embedding) as bigint) as n, embedding[1] as first from embeddings")
def _(t):
    return select(vec_id="v.vec_id", n="cast(size(v.embedding) AS bigint)", first="v.embedding[0]").from_(v=t.embeddings)()


@entry("conditional", "select o_orderkey, case when o_totalprice > 250000 then 'hi' else 'lo' end as band, coalesce(o_orderpriority, 'none') as p from orders")
def _(t):
    return select(o_orderkey="o.o_orderkey", band="CASE WHEN o.o_totalprice > 250000 THEN 'hi' ELSE 'lo' END", p="coalesce(o.o_orderpriority, 'none')").from_(o=t.orders)()


@entry("compare_function", "select s_suppkey, case when s_acctbal < 0 then -1 when s_acctbal > 0 then 1 else 0 end as c from supplier")
def _(t):
    return select(s_suppkey="s.s_suppkey", c="cmp(s.s_acctbal, 0)").from_(s=t.supplier)()


@entry("insert_from_select", "select r_regionkey, r_name from region union all select cast(n_nationkey + 100 as int) as r_regionkey, n_name as r_name from nation where n_regionkey = 1")
def _(t):
    region = t.keyed("region", "r_regionkey")
    with transaction() as txn:
        insert(r_regionkey="n.n_nationkey + 100", r_name="n.n_name").into(region).from_(n=t.nation).where("n.n_regionkey = 1")(txn=txn)
    return select("r.*").from_(r=region)()


@entry("upsert_from_select", "select r_regionkey, r_name from region where r_regionkey > 1 union all select n_regionkey as r_regionkey, max(n_name) as r_name from nation where n_regionkey <= 1 group by n_regionkey")
def _(t):
    region = t.keyed("region", "r_regionkey")
    first = select(k="n.n_regionkey", name="max(n.n_name)").from_(n=t.nation).where("n.n_regionkey <= 1").group_by("n.n_regionkey")
    with transaction() as txn:
        upsert(r_regionkey="f.k", r_name="f.name").into(region).from_(f=first)(txn=txn)
    return select("r.*").from_(r=region)()


@entry("update_where", "select n_nationkey, case when n_regionkey = 1 then lower(n_name) else n_name end as n_name, n_regionkey from nation")
def _(t):
    nation = t.keyed("nation", "n_nationkey")
    with transaction() as txn:
        update(n_name="lower(this.n_name)").into(nation).where("this.n_regionkey = :r")(txn=txn, r=1)
    return select("n.*").from_(n=nation)()


@entry("update_returning", "select n_nationkey, lower(n_name) as name from nation where n_regionkey = 1")
def _(t):
    return update(n_name="lower(this.n_name)").into(t.keyed("nation", "n_nationkey")).where("this.n_regionkey = 1").returning(n_nationkey="this.n_nationkey", name="this.n_name")()


@entry("delete_where", "select n_nationkey, n_name, n_regionkey from nation where not (n_regionkey = 2)")
def _(t):
    nation = t.keyed("nation", "n_nationkey")
    with transaction() as txn:
        delete_from(nation).where("this.n_regionkey = 2")(txn=txn)
    return select("n.*").from_(n=nation)()


@entry("delete_count", "select count(*) as count from nation where n_regionkey = 2")
def _(t):
    return delete_from(t.keyed("nation", "n_nationkey")).where("this.n_regionkey = 2")()


@entry("delete_with_join", "select n_nationkey, n_name from nation where n_regionkey not in (select r_regionkey from region where r_name = 'ASIA')")
def _(t):
    nation = t.keyed("nation", "n_nationkey")
    delete_from(nation).join(r=t.region).on("this.n_regionkey = r.r_regionkey").where("r.r_name = 'ASIA'")()
    return select("n.n_nationkey", "n.n_name").from_(n=nation)()


@entry("update_from_join", "select n.n_nationkey, case when r.r_regionkey is not null then r.r_name else n.n_name end as n_name from nation n left join (select * from region where r_regionkey < 2) r on n.n_regionkey = r.r_regionkey")
def _(t):
    nation = t.keyed("nation", "n_nationkey")
    with transaction() as txn:
        update(n_name="r.r_name").into(nation).join(r=t.region).on("this.n_regionkey = r.r_regionkey").where("r.r_regionkey < 2")(txn=txn)
    return select("n.n_nationkey", "n.n_name").from_(n=nation)()


@entry("custom_aggregate", "select label, count(1) as n, bit_xor(vec_id) as x from embeddings group by label")
def _(t):
    return select(label="v.label", n="count(1)", x="xor_all(v.vec_id)").from_(v=t.embeddings).group_by("v.label")()


@entry("filter_in_param", "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (3, 5, 7)")
def _(t):
    return select("c.c_custkey", "c.c_mktsegment").from_(c=t.customer).where("c.c_mktsegment IN (:segments)").where("c.c_nationkey NOT IN (?)", [3, 5, 7])(segments=["BUILDING", "MACHINERY"])


@entry("filter_composite_prefix", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey = 7 and l_linenumber >= 2 and l_linenumber < 6")
def _(t):
    where = ranges.composite([(F.col("l.l_orderkey"), Range.equal(7)), (F.col("l.l_linenumber"), Range(2, 6, upper_open=True))])
    return select("l.l_orderkey", "l.l_linenumber", "l.l_quantity").from_(l=t.keyed("lineitem", ["l_orderkey", "l_linenumber"])).where(where)()


@entry("filter_ranges_combined", "select p_partkey, p_size from part where (p_size < 10 or p_size > 30) and p_size >= 5 and p_size <= 40")
def _(t):
    size = F.col("p.p_size")
    return select("p.p_partkey", "p.p_size").from_(p=t.part).where(ranges.union(size, [Range(None, 10, upper_open=True), Range(30, None, lower_open=True)])).where(ranges.intersection(size, [Range(5, 40), Range(1, 45)]))()


@entry("range_from_columns", "select n.n_nationkey, r.r_regionkey from nation n join region r on n.n_nationkey >= r.r_regionkey * 5 and n.n_nationkey < (r.r_regionkey + 1) * 5")
def _(t):
    return select("n.n_nationkey", "r.r_regionkey").from_(n=t.nation).join(r=t.region).on("n.n_nationkey >= r.r_regionkey * :w AND n.n_nationkey < (r.r_regionkey + 1) * :w")(w=5)


@entry("memory_rows", "select n.n_name, v.label from nation n join (values (0, 'a'), (2, 'b'), (4, 'c')) v(k, label) on v.k = n.n_regionkey")
def _(t):
    return select("n.n_name", "v.label").from_(n=t.nation).join(v=[{"k": 0, "label": "a"}, None, {"k": 2, "label": "b"}, {"k": 4, "label": "c"}]).on("v.k = n.n_regionkey")()


@entry("memory_lookup", "select n_name, case n_regionkey when 1 then 'west' else 'east' end as side from nation where n_regionkey in (1, 2)")
def _(t):
    sides = Store.rows({"1": {"side": "west"}, "2": {"side": "east"}})  # by hidden key
    return select(n_name="n.n_name", side="s.side").from_(n=t.nation).join(s=sides).on("s._pk = cast(n.n_regionkey AS string)")()


@entry("nested_key_path", "select n_nationkey, case when n_nationkey = 3 then 'changed' else n_name end as n_name from nation where n_nationkey <> 4")
def _(t):
    nested = Store.dataframe(select(id="named_struct('key', n.n_nationkey)", n_name="n.n_name").from_(n=t.nation)(), key="id.key")
    with transaction() as txn:
        update(n_name="'changed'").into(nested).where("this.id.key = 3")(txn=txn)
        delete_from(nested).where("this.id.key = 4")(txn=txn)
    return select(n_nationkey="n.id.key", n_name="n.n_name").from_(n=nested)()


@entry("bare_columns", "select n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey > 10")
def _(t):
    return select(n_name="n_name", r_name="r_name").from_(n=t.nation).join(r=t.region).on("n_regionkey = r_regionkey").where("n_nationkey > 10")()


@entry("group_dependent_column", "select n.n_regionkey, r.r_name, count(1) as n from nation n join region r on n.n_regionkey = r.r_regionkey group by n.n_regionkey, r.r_name")
def _(t):
    return select(n_regionkey="n.n_regionkey", r_name="r.r_name", n="count(1)").from_(n=t.nation).join(r=t.region).on("n.n_regionkey = r.r_regionkey").group_by("n.n_regionkey")()


@entry("group_then_order", "select c_mktsegment, count(1) as n from customer group by c_mktsegment order by n desc, c_mktsegment")
def _(t):
    return select(c_mktsegment="c.c_mktsegment", n="count(1)").from_(c=t.customer).group_by("c.c_mktsegment").order_by("n").desc.order_by("c_mktsegment")()


@entry("group_of_groups", "select n, count(1) as customers from (select o_custkey, count(1) as n from orders group by o_custkey) t group by n")
def _(t):
    return select(k="o.o_custkey", n="count(1)").from_(o=t.orders).group_by("o.o_custkey").select(n="n", customers="count(1)").group_by("n")()


@entry("lateral_subquery", "select c.c_custkey, b.o_orderkey, b.share from customer c, lateral (select o.o_orderkey, o.o_totalprice / c.c_acctbal as share from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal * 40) b where c.c_acctbal > 5000")
def _(t):
    big = select(o_orderkey="o.o_orderkey", share="o.o_totalprice / c.c_acctbal").from_(o=t.orders).where("o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 40")
    return select("c.c_custkey", "b.o_orderkey", "b.share").from_(c=t.customer).join(b=big).where("c.c_acctbal > 5000")()


@entry("right_join_older_rule", "select n.n_name, r.r_name from (select * from nation where n_nationkey < 8) n right join (select * from region where r_regionkey < 3) r on n.n_regionkey = r.r_regionkey")
def _(t):
    return select("n.n_name", "r.r_name").from_(n=t.nation).right_join(r=t.region).on("n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3").where("n.n_nationkey < 8").compat()()


@entry("full_join_older_rule", "select n.n_name, r.r_name from (select * from nation where n_nationkey < 8) n full join (select * from region where r_regionkey < 3) r on n.n_regionkey = r.r_regionkey")
def _(t):
    return select("n.n_name", "r.r_name").from_(n=t.nation).full_join(r=t.region).on("n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3 AND n.n_nationkey < 8").compat()()


@entry("memoized_then_derived", "with t as (select c_nationkey as k, count(1) as n from customer group by c_nationkey) select a.k as k1, b.k as k2 from t a join t b on a.n = b.n and a.k < b.k where a.k > 3")
def _(t):
    counts = select(k="c.c_nationkey", n="count(1)").from_(c=t.customer).group_by("c.c_nationkey").memoize
    return select(k1="a.k", k2="b.k").from_(a=counts, b=counts).where("a.n = b.n AND a.k < b.k")().filter("k1 > 3")


@entry("bitwise_functions", "select o_orderkey, o_orderkey & 12 as a, o_orderkey | 5 as o, xor(o_orderkey, 9) as x, ~o_orderkey as n, o_orderkey << 2 as l, o_orderkey >> 1 as r from orders")
def _(t):
    return select(o_orderkey="o.o_orderkey", a="o.o_orderkey & 12", o="o.o_orderkey | 5", x="o.o_orderkey ^ 9", n="~o.o_orderkey", l="shiftleft(o.o_orderkey, 2)", r="shiftright(o.o_orderkey, 1)").from_(o=t.orders)()


@entry("regex_functions", "select p_partkey, regexp_matches(p_brand, '[1-3]$') as m, regexp_replace(p_type, '[AEIOU]', '_', 'g') as r, regexp_extract(p_brand, '([0-9]+)', 1) as d from part")
def _(t):
    return select(p_partkey="p.p_partkey", m="p.p_brand RLIKE '[1-3]$'", r="regexp_replace(p.p_type, '[AEIOU]', '_')", d="regexp_extract(p.p_brand, '([0-9]+)', 1)").from_(p=t.part)()


@entry("struct_and_map_functions", "select n_nationkey, n_name as name, n_regionkey * 2 as twice, cast(2 as bigint) as size, n_regionkey as found from nation")
def _(t):
    row = select(k="n.n_nationkey", s="named_struct('name', n.n_name, 'in', named_struct('r', n.n_regionkey))", m="map('r', n.n_regionkey, 'k', n.n_nationkey)").from_(n=t.nation)
    return select(n_nationkey="x.k", name="x.s.name", twice="x.s.in.r * 2", size="cast(cardinality(x.m) AS bigint)", found="x.m['r']").from_(x=row)()


@entry("lambda_functions", "select vec_id, cast(list_sum(list_transform(embedding, lambda x: case when x > 0.1 then 2 else 1 end)) as bigint) as weight, cast(len(list_filter(embedding, lambda x: x > 0)) as bigint) as positive from embeddings")
def _(t):
    return select(vec_id="v.vec_id", weight="cast(aggregate(transform(v.embedding, x -> CASE WHEN x > 0.1 THEN 2 ELSE 1 END), 0, (a, x) -> a + x) AS bigint)", positive="cast(size(filter(v.embedding, x -> x > 0)) AS bigint)").from_(v=t.embeddings)()


@entry("scalar_udf", "select s_suppkey, s_acctbal * 2 + 1 as v, upper(s_name) || '!' as loud from supplier")
def _(t):
    register("twice_and_one", F.pandas_udf(lambda s: s * 2 + 1, "double"))
    register("loud", "concat(upper({0}), '!')")
    return select(s_suppkey="s.s_suppkey", v="twice_and_one(s.s_acctbal)", loud="loud(s.s_name)").from_(s=t.supplier)()


@entry("partial_parameters", "select c_custkey from customer where c_nationkey = 7 and c_acctbal > 1000")
def _(t):
    some = select(c_custkey="c.c_custkey").from_(c=t.customer).where("c.c_nationkey = :nation AND c.c_acctbal > :least").partial(nation=3, least=1000)
    return some(nation=7)


@entry("collected_rows", "select r_regionkey, r_name from region where r_regionkey > 0 union all select r_regionkey, lower(r_name) as r_name from region where r_regionkey > 1")
def _(t):
    q = select("r.*").from_(r=t.region).where("r.r_regionkey > :k")
    seen = [tuple(r) for r in q.collect(k=0)]
    q.for_each(lambda r: seen.append((r.r_regionkey, r.r_name.lower())), k=1)
    return t.rows(seen, "r_regionkey int, r_name string")


@entry("finalized_relation", "select n_name from nation where n_nationkey < 9 and n_regionkey = 1")
def _(t):
    final = select(n_name="n.n_name", r="n.n_regionkey").from_(n=t.nation).where("n.n_nationkey < :k").finalize()
    assert final.tree()["kind"] == "select"
    return select(n_name="x.n_name").from_(x=final.relation(k=9)).where("x.r = 1")()


def _raised(f: Callable[[], object], kind: type[QueryError]) -> bool:
    try:
        f()
    except QueryError as e:
        return isinstance(e, kind)
    return False


@entry("builder_errors", "select * from (values ('aggregate in where', true), ('alias twice', true), ('edit after finalize', true), ('group without selector', true), ('into twice', true), ('no parameter', true), ('no relation', true), ('nothing to write into', true), ('returning twice', true), ('reserved alias', true), ('select twice', true), ('unknown alias', true)) t(name, raised)")
def _(t):
    base = select(n="n.n_name").from_(n=t.nation)
    wrong: dict[str, tuple[Callable[[], object], type[QueryError]]] = {
        "select twice": (lambda: base.select(x="1"), QueryError), "alias twice": (lambda: base.join(n=t.region), AliasError),
        "reserved alias": (lambda: base.join({"$$x": t.region}), AliasError), "unknown alias": (lambda: base.where("z.a = 1")(), AliasError),
        "aggregate in where": (lambda: base.where("sum(n.n_nationkey) > 1"), AggregateError), "no relation": (lambda: base.join(x=3), QueryError),
        "group without selector": (lambda: Query().from_(n=t.nation).group_by("1"), QueryError), "edit after finalize": (lambda: base.finalize().where("1 = 1"), QueryError),
        "no parameter": (lambda: base.where("n.n_name = :x")(), ParameterError), "nothing to write into": (lambda: insert(x="1")(), QueryError),
        "into twice": (lambda: insert(x="1").into(t.region).into(t.region), QueryError), "returning twice": (lambda: insert(x="1").returning("*").returning("*"), QueryError),
    }
    return t.rows([(name, _raised(f, kind)) for name, (f, kind) in wrong.items()], "name string, raised boolean")


@entry("write_errors", "select * from (values ('duplicate key', true), ('ended transaction', true), ('key changed', true), ('no key', true), ('same key twice', true), ('several matches', true)) t(name, raised)")
def _(t):
    region = t.keyed("region", "r_regionkey")
    ended = transaction()
    ended.commit()
    wrong = {
        "duplicate key": lambda: insert("r.*").into(region).from_(r=t.region)(), "no key": lambda: insert(r_name="'x'").into(region)(),
        "same key twice": lambda: insert(r_regionkey="77", r_name="n.n_name").into(region).from_(n=t.nation)(),
        "key changed": lambda: update(r_regionkey="1").into(region)(), "ended transaction": lambda: delete_from(region)(txn=ended),
        "several matches": lambda: update(r_name="n.n_name").into(region).join(n=t.nation).on("n.n_regionkey = this.r_regionkey")(),
    }
    assert _raised(wrong["ended transaction"], TransactionError)
    return t.rows([(name, _raised(f, QueryError)) for name, f in wrong.items()], "name string, raised boolean")


@entry("parquet_insert", "select n_nationkey, n_name from nation union all select n_nationkey + 100 as n_nationkey, lower(n_name) as n_name from nation where n_regionkey = 2")
def _(t):
    nation = t.copy("nation", "n_nationkey")
    insert(n_nationkey="n.n_nationkey + 100", n_name="lower(n.n_name)", n_regionkey="n.n_regionkey").into(nation).from_(n=nation).where("n.n_regionkey = 2")()
    return select("n.n_nationkey", "n.n_name").from_(n=nation)()


@entry("parquet_upsert_update_delete", "select o_orderkey, case when o_orderkey = 3 then -1.0 when o_orderkey % 7 = 1 then 0.0 else o_totalprice end as o_totalprice from orders where o_orderkey % 5 <> 0")
def _(t):
    orders = t.copy("orders", "o_orderkey")
    update(o_totalprice="0.0D").into(orders).where("this.o_orderkey % 7 = 1")()
    delete_from(orders).where("this.o_orderkey % 5 = 0")()
    upsert("o.*").into(orders).from_(o=select("x.*").from_(x=orders).where("x.o_orderkey = 3")().withColumn("o_totalprice", F.lit(-1.0)))()
    orders.vacuum()
    return select("o.o_orderkey", "o.o_totalprice").from_(o=orders.refresh())()


@entry("parquet_transaction", "select 'nation' as name, count(*) as n from nation where n_regionkey <> 1 union all select 'region' as name, count(*) as n from region where r_regionkey <> 1")
def _(t):
    nation, region = t.copy("nation", "n_nationkey"), t.copy("region", "r_regionkey")
    with transaction() as txn:
        delete_from(nation).join(r=region).on("r.r_regionkey = this.n_regionkey").where("r.r_regionkey = 1")(txn=txn)
        delete_from(region).where("this.r_regionkey = 1")(txn=txn)
    return select(name="'nation'", n="count(1)").from_(n=nation).group_by("1").union_all(select(name="'region'", n="count(1)").from_(r=region).group_by("1"))()


@entry("parquet_conflict", "select 'another writer' as error, count(*) + 1 as n from region")
def _(t):
    one = t.copy("region", "r_regionkey")
    two = Store.parquet(one.log.path, "r_regionkey")
    insert(r_regionkey="50", r_name="'one'").into(one)()
    lost = _raised(lambda: insert(r_regionkey="51", r_name="'two'").into(two)(), TransactionError)
    return select(error="'another writer'" if lost else "'none'", n="count(1)").from_(r=two.refresh()).group_by("1")()


@entry("transaction_overlay", "select 'before' as seen, count(*) as n from nation union all select 'within' as seen, count(*) as n from nation where n_regionkey <> 3 union all select 'aborted' as seen, count(*) as n from nation")
def _(t):
    nation = t.keyed("nation", "n_nationkey")
    count = lambda seen, txn=None: (seen, select(x="n.n_nationkey").from_(n=nation)(txn=txn).count())
    before, txn = count("before"), transaction()
    delete_from(nation).where("this.n_regionkey = 3")(txn=txn)
    within = count("within", txn)
    txn.abort()
    return t.rows([before, within, count("aborted")], "seen string, n bigint")


@entry("insert_reads_before_it_writes", "select r_regionkey, r_name from region union all select r_regionkey + 10 as r_regionkey, r_name from region")
def _(t):
    region = t.keyed("region", "r_regionkey")
    with transaction() as txn:
        insert(r_regionkey="r.r_regionkey + 10", r_name="r.r_name").into(region).from_(r=region)(txn=txn)
    return select("r.*").from_(r=region)()


@entry("generated_keys", "select r_regionkey as k, r_name from region where r_regionkey < 4 union all select n_nationkey + 5 as k, n_name as r_name from nation where n_nationkey < 3")
def _(t):
    region = Store.dataframe(t.region.df, "r_regionkey", auto=True)
    delete_from(region).where("this.r_regionkey = 4")()  # its key isn't given again
    for k in range(3):
        insert(r_name="n.n_name").into(region).from_(n=t.nation).where("n.n_nationkey = :k")(k=k)
    return select(k="r.r_regionkey", r_name="r.r_name").from_(r=region)()


@entry("empty_write_set", "select 0 as count, count(*) as n from region")
def _(t):
    region = t.keyed("region", "r_regionkey")
    n = insert("r.*").into(region).from_(r=t.region).where("r.r_regionkey < 0")().first()["count"]
    n += delete_from(region).where("this.r_regionkey < 0")().first()["count"] + update(r_name="'x'").into(region).where("this.r_regionkey < 0")().first()["count"]
    return select(count=f"{n}", n="count(1)").from_(r=region).group_by("1")()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()}
