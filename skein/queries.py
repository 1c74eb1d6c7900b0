"""Queries over the driver's tables, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import job
from skein.operators import graph
from skein.operators.flow import Flow
from skein.plans import algorithms
from skein.plans.loops import EmitKind, IterCondition
from skein.session import ensure_checkpoint_dir
from skein.sources import delimited, encode_edges, input_from, input_range, load_edges, own_source, partition_edges, properties, text_lines, worker_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as flows."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> Flow:
        return Flow(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def query(sql: str | None = None):
    """Register a function of Tables; its name is the query's."""

    def keep(f):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out if isinstance(out, DataFrame) else out.df

        QUERIES[f.__name__] = call
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


CENTS = "cast(round({0} * 100) as bigint)"

# -- rows ----------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as revenue from lineitem")
def map_projection(t):
    return t.lineitem.map(l_orderkey="l_orderkey", l_linenumber="l_linenumber", revenue="l_extendedprice * (1 - l_discount)")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 10 and l_returnflag = 'R'")
def filter_predicate(t):
    return t.lineitem.filter("l_quantity < 10 and l_returnflag = 'R'").map(l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_quantity="l_quantity")


@query("select o_orderkey as big, o_orderstatus from orders where o_totalprice > 100000")
def filter_map_expr(t):
    return t.orders.filter_map(big="case when o_totalprice > 100000 then o_orderkey end", o_orderstatus="o_orderstatus")


@query("select doc_id, unnest(string_split(text, ' ')) as word from documents")
def flat_map_words(t):
    return t.documents.flat_map("split(text, ' ')", "word", ["doc_id"])


@query("select c_custkey + 1 as x from customer")
def unary_arrow(t):
    def add(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.add(b.column(0), 1)], names=["x"])

    return t.customer.map(x="c_custkey").map_arrow(add, "x long")


@query("select word, count(*) as count from (select unnest(string_split(text, ' ')) as word from documents) where word <> '' group by word")
def word_count(t):
    return algorithms.word_count(t.documents, "text")


@query("select s_suppkey as x, abs(s_suppkey % 7 - 3) as y, xor(s_suppkey, 5) as z from supplier")
def scalar_arithmetic(t):
    return t.supplier.map(x="s_suppkey", y="abs(s_suppkey % 7 - 3)", z="s_suppkey ^ 5")


@query("select distinct l_partkey, l_suppkey from lineitem")
def dedup_keys(t):
    return t.lineitem.map(l_partkey="l_partkey", l_suppkey="l_suppkey").dedup()


@query("select c_custkey as id from customer union all select s_suppkey from supplier")
def merge_union_all(t):
    return t.customer.map(id="c_custkey").merge(t.supplier.map(id="s_suppkey"))


@query("select n_nationkey as x from nation union all select n_nationkey from nation union all select n_nationkey from nation")
def merge_copied(t):
    a, b = t.nation.map(x="n_nationkey").copied()
    return a.merge(b).merge(a)


@query("select 0 as tag, c_custkey as a_key, null::varchar as b_name from customer union all select 1, null, s_name from supplier")
def merge_isomer_tagged(t):
    both = t.customer.map(key="c_custkey").merge_isomer(t.supplier.map(name="s_name"))
    return both.map(tag="either.tag", a_key="either.a.key", b_name="either.b.name")


@query("select o_totalprice >= 150000 as dear, count(*) as n from orders group by 1")
def branch_split(t):
    dear, cheap = t.orders.branch("o_totalprice >= 150000")
    return dear.count("n").map(dear="true", n="n").into_flow().merge(cheap.count("n").map(dear="false", n="n").into_flow())


@query("select l_suppkey, sum(n)::bigint as n from (select l_suppkey, count(*) as n from lineitem group by 1 union all select s_suppkey, 1 from supplier) group by 1")
def binary_cogroup(t):
    def count(left, right):
        import pyarrow as pa

        key = (left if len(left) else right).column("k")[0]
        return pa.table({"l_suppkey": pa.array([key.as_py()], pa.int64()), "n": pa.array([len(left) + len(right)], pa.int64())})

    return t.lineitem.map(k="l_suppkey").key_by(k="k").binary(t.supplier.map(k="s_suppkey").key_by(k="k"), count, "l_suppkey long, n long")


@query("""select a.n_nationkey, b.s_suppkey from (select n_nationkey, row_number() over (order by n_name) as i from nation) a
join (select s_suppkey, row_number() over (order by s_acctbal, s_suppkey) as i from supplier) b on a.i = b.i""")
def zip_indexed(t):
    return t.nation.map(n_nationkey="n_nationkey", n_name="n_name").zip(t.supplier.map(s_suppkey="s_suppkey", s_acctbal="s_acctbal"), ["n_name"], ["s_acctbal", "s_suppkey"]).map(n_nationkey="n_nationkey", s_suppkey="s_suppkey")


# -- partitions ----------------------------------------------------------------------------------------------


@query("select (o_custkey % 4)::integer as worker, count(*) as n from orders group by 1")
def repartition_identity(t):
    return t.orders.map(o_custkey="o_custkey").repartition("o_custkey", 4).fold_partition(n="count(*)")


@query("select n_nationkey, w::integer as worker from nation, range(3) r(w)")
def broadcast_replicate(t):
    return t.nation.map(n_nationkey="n_nationkey").broadcast(3)


@query("select (o_orderkey % 3)::integer as worker, max(o_custkey) as m from orders group by 1")
def reduce_partition(t):
    return t.orders.map(o_orderkey="o_orderkey", o_custkey="o_custkey").repartition("o_orderkey", 3).reduce_partition(m="max(o_custkey)")


@query("select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey % 4 order by o_totalprice desc, o_orderkey) as n from orders) where n <= 2")
def limit_partition(t):
    return t.orders.map(o_orderkey="o_orderkey", o_custkey="o_custkey", o_totalprice="o_totalprice").repartition("o_custkey", 4).limit_partition(2, F.desc("o_totalprice"), "o_orderkey").map(o_orderkey="o_orderkey")


@query("select l_suppkey, count(*) as n, 1::bigint as workers from lineitem group by 1")
def partition_by_key(t):
    """All rows of a key are with one worker."""
    own = t.lineitem.map(l_suppkey="l_suppkey").key_by(l_suppkey="l_suppkey").partition_by_key(8).extend(worker=worker_index())
    return own.reduce_by_key(n="count(*)", workers="count(distinct worker)")


@query("select count(*) as n, 1::bigint as workers from lineitem")
def aggregate_one(t):
    """All rows are with one worker."""
    return t.lineitem.map(x="l_orderkey").aggregate().extend(worker=worker_index()).reduce(n="count(*)", workers="count(distinct worker)")


@query("select n_nationkey, (n_nationkey % 4)::integer as worker from nation")
def worker_of_row(t):
    """The worker that a route names is the one that a row is with."""
    return t.nation.map(n_nationkey="n_nationkey").repartition("n_nationkey", 4).extend(worker=worker_index())


@query("select 0 as worker, 0::bigint as n")
def fold_partition_empty(t):
    """Without rows, worker 0 gives the initial value."""
    return t.orders.filter("o_totalprice < 0").map(o_custkey="o_custkey").repartition("o_custkey", 4).fold_partition_from(n=("0L", "sum(o_custkey)"))


def _tally() -> type:
    """A class that goes to the tasks with its code."""

    class Tally:
        """Passes rows on, and gives their number at the end."""

        def __init__(self) -> None:
            self.n = 0

        def on_batch(self, batch):
            self.n += len(batch)
            yield batch

        def on_end(self):
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"y": [-self.n]}, pa.schema([("y", pa.int64())]))

    return Tally


@query("select n_nationkey as x, ((n_nationkey + 1) * (n_nationkey + 2) // 2)::bigint as s, -(n_nationkey + 1)::bigint as last, (n_nationkey + 2)::bigint as n from nation")
def stateful_scope(t):
    """An operator with state for each subtask; the number of its rows comes when they are over."""
    body = lambda f: f.flat_map("sequence(1L, x + 1L)", "y").stateful(_tally(), "y long").reduce(s="sum(case when y > 0 then y end)", last="min(y)", n="count(*)")
    return t.nation.map(x="n_nationkey").apply(body, unique="x")


@query("select -count(*) as y from orders group by o_custkey % 4")
def stateful_partition(t):
    """The same with state for each of four workers."""
    return t.orders.map(y="o_custkey").repartition("y", 4).stateful(_tally(), "y long").filter("y < 0")


@query("select n_nationkey as x, 1 as a, 2 as b, 3 as c, 0 as d from nation")
def scope_levels(t):
    """How deep subtasks and loops are nested, asked from inside."""
    seen: list[int] = []

    def inner(g):
        seen.append(g.level)
        return g.count("inner")

    def loop(f):
        seen.append(f.level)
        return f.apply(inner, unique="x").map(x="x")

    def body(f):
        seen.append(f.level)
        return f.iterate(1, loop).count("n")

    out = t.nation.map(x="n_nationkey").apply(body, unique="x")
    return out.map(x="x", a=F.lit(seen[0]), b=F.lit(seen[1]), c=F.lit(seen[2]), d=F.lit(out.level))


# -- aggregates ----------------------------------------------------------------------------------------------


@query("select count(*) as n from lineitem")
def count_global(t):
    return t.lineitem.count("n")


@query("select count(*) as n from lineitem where l_quantity < 0")
def count_empty_default(t):
    return t.lineitem.filter("l_quantity < 0").count("n")


@query(f"select sum({CENTS.format('l_extendedprice')})::bigint as cents from lineitem")
def fold_sum(t):
    return t.lineitem.fold(cents=(F.lit(0).cast("long"), f"sum({CENTS.format('l_extendedprice')})"))


@query("select -1::bigint as m from region limit 1")
def fold_empty_default(t):
    return t.lineitem.filter("l_quantity < 0").fold(m=("-1L", "max(l_orderkey)"))


@query("select bit_xor(o_orderkey) as x from orders")
def fold_with_step(t):
    xor = lambda acc, x: acc.bitwiseXOR(x)
    return t.orders.fold_with("x", "o_orderkey", "0L", xor, xor)


@query("select max(o_totalprice) as m, min(o_orderkey) as k from orders")
def reduce_global(t):
    return t.orders.reduce(m="max(o_totalprice)", k="min(o_orderkey)")


@query("select bit_xor(o_orderkey) as x from orders")
def reduce_generic(t):
    """A function of two rows that is no built-in aggregate; the first row is the seed."""
    return t.orders.reduce_with("x", "o_orderkey", lambda a, b: a.bitwiseXOR(b))


@query("select o_custkey, bit_xor(o_orderkey) as x from orders group by 1")
def segment_reduce_generic(t):
    own = t.orders.map(o_custkey="o_custkey", o_orderkey="o_orderkey").key_by(o_custkey="o_custkey")
    return own.segment_apply(lambda f: f.reduce_with("x", "o_orderkey", lambda a, b: a.bitwiseXOR(b)))


@query("select max(l_orderkey) as m from lineitem where l_quantity < 0 having count(*) > 0")
def reduce_empty_drops(t):
    return t.lineitem.filter("l_quantity < 0").reduce(m="max(l_orderkey)")


@query("select exists (select 1 from orders where o_totalprice > 1000) as found, exists (select 1 from orders where o_totalprice < 0) as none")
def any_exists(t):
    a = t.orders.filter("o_totalprice > 1000").any("found").df
    return a.crossJoin(t.orders.filter("o_totalprice < 0").any("none").df)


@query("select string_agg(n_nationkey::varchar, ',' order by n_nationkey) as v from nation")
def collect_sorted(t):
    return t.nation.collect("n_nationkey", "values").map(v="array_join(cast(values as array<string>), ',')")


@query("select unnest(list_sort(list(n_nationkey))) as x from nation")
def single_unfold(t):
    return t.nation.collect("n_nationkey").unfold("values", "x")


@query("select l_suppkey, count(*) as n, sum(l_quantity::bigint)::bigint as q, max(l_extendedprice) as top from lineitem group by 1")
def reduce_by_key(t):
    return t.lineitem.key_by(l_suppkey="l_suppkey").reduce_by_key(n="count(*)", q="sum(cast(l_quantity as bigint))", top="max(l_extendedprice)")


@query("select o_custkey, coalesce(sum(case when o_orderstatus = 'F' then 1 end), 0)::bigint as f from orders group by 1")
def fold_by_key(t):
    return t.orders.key_by(o_custkey="o_custkey").fold_by_key(f=("0L", "sum(case when o_orderstatus = 'F' then 1L end)"))


@query("select o_orderpriority, count(*) as n, max(o_orderkey) as last from orders group by 1")
def segment_apply(t):
    own = t.orders.key_by(o_orderpriority="o_orderpriority")
    return own.segment_apply(lambda f: f.fold(n=("0L", "count(*)"), last=("0L", "max(o_orderkey)")))


# -- joins ---------------------------------------------------------------------------------------------------


def _sides(t):
    """All customers, and all orders with keys moved by 100: either side has keys that the other lacks."""
    left = t.customer.map(k="c_custkey", c_name="c_name").key_by(k="k")
    right = t.orders.map(k="o_custkey + 100", o_orderkey="o_orderkey").key_by(k="k")
    return left, right


L = "(select c_custkey as k, c_name from customer) l"
R = "(select o_custkey + 100 as right_k, o_orderkey from orders) r"


@query(f"select * from {L} join {R} on k = right_k")
def inner_join(t):
    left, right = _sides(t)
    return left.inner_join(right)


@query(f"select * from {L} left join {R} on k = right_k")
def left_outer_join(t):
    left, right = _sides(t)
    return left.left_outer_join(right)


@query(f"select * from {L} right join {R} on k = right_k")
def right_outer_join(t):
    left, right = _sides(t)
    return left.right_outer_join(right)


@query(f"select * from {L} full join {R} on k = right_k")
def full_outer_join(t):
    left, right = _sides(t)
    return left.full_outer_join(right)


@query(f"select * from {L} where exists (select 1 from {R} where k = right_k)")
def semi_join(t):
    left, right = _sides(t)
    return left.semi_join(right)


@query(f"select * from {L} where not exists (select 1 from {R} where k = right_k)")
def anti_join(t):
    left, right = _sides(t)
    return left.anti_join(right)


@query("""select l.k, c_custkey, n_nationkey from (select nullif(c_nationkey % 5, 0) as k, c_custkey from customer) l
join (select nullif(n_nationkey % 5, 0) as k, n_nationkey from nation) r on l.k is not distinct from r.k""")
def null_key_join(t):
    left = t.customer.map(k="nullif(c_nationkey % 5, 0)", c_custkey="c_custkey").key_by(k="k")
    right = t.nation.map(k="nullif(n_nationkey % 5, 0)", n_nationkey="n_nationkey").key_by(k="k")
    return left.inner_join(right).map(k="k", c_custkey="c_custkey", n_nationkey="n_nationkey")


# -- order ---------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey")
def sort_global(t):
    return t.orders.map(o_orderkey="o_orderkey", o_totalprice="o_totalprice").sort_by(F.desc("o_totalprice"), "o_orderkey")


@query("select count(*) as n from (select * from lineitem limit 10)")
def limit_count(t):
    return t.lineitem.limit(10).count("n")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def sort_limit_topk(t):
    return t.orders.map(o_orderkey="o_orderkey", o_totalprice="o_totalprice").sort_limit_by(10, F.desc("o_totalprice"), "o_orderkey")


@query("select 10 as n from region limit 1")
def early_stop(t):
    """Ten rows of a flow without end."""
    from skein.functions import flat_map_rows

    def forever(row):
        while True:
            yield {"x": row["x"]}

    import pyarrow as pa

    return t.region.map(x="cast(r_regionkey as bigint)").map_arrow(flat_map_rows(forever, pa.schema([("x", pa.int64())])), "x long").limit(10).count("n").map(n="cast(n as int)")


# -- subtasks ------------------------------------------------------------------------------------------------


def _orders(t, *columns):
    """All orders, with keys moved by 5: some customers have none."""
    return t.orders.df.select((F.col("o_custkey") + 5).alias("c_custkey"), *columns)


O = "(select * replace (o_custkey + 5 as o_custkey) from orders) o"  # noqa: E741


def _customers(t):
    return t.customer.map(c_custkey="c_custkey", c_name="c_name")


@query(f"select c_custkey, c_name, (select count(*) from {O} where o_custkey = c_custkey) as n from customer")
def apply_count(t):
    return _customers(t).apply(lambda f: f.lookup(_orders(t, "o_orderkey"), "c_custkey").count("n"), unique="c_custkey")


@query(f"select c_custkey, c_name, coalesce((select string_agg(o_orderkey::varchar, ',' order by o_orderkey) from {O} where o_custkey = c_custkey), '') as v from customer")
def apply_collect(t):
    return _customers(t).apply(lambda f: f.lookup(_orders(t, "o_orderkey"), "c_custkey").collect("o_orderkey", "values"), unique="c_custkey").map(c_custkey="c_custkey", c_name="c_name", v="array_join(cast(values as array<string>), ',')")


@query(f"select c_custkey, c_name, max(o_totalprice) as top from customer join {O} on o_custkey = c_custkey group by 1, 2")
def apply_reduce_inner(t):
    return _customers(t).apply(lambda f: f.lookup(_orders(t, "o_totalprice"), "c_custkey").reduce(top="max(o_totalprice)"), unique="c_custkey")


@query(f"select c_custkey, c_name, exists (select 1 from {O} where o_custkey = c_custkey and o_totalprice > 200000) as dear from customer")
def apply_any(t):
    return _customers(t).apply(lambda f: f.lookup(_orders(t, "o_totalprice"), "c_custkey").filter("o_totalprice > 200000").any("dear"), unique="c_custkey")


@query(f"""select c_custkey, c_name, coalesce((select string_agg(o_orderkey::varchar, ',' order by o_orderkey) from
(select o_orderkey from {O} where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 3) x), '') as v from customer""")
def apply_topk(t):
    top = _customers(t).apply(lambda f: f.lookup(_orders(t, "o_orderkey", "o_totalprice"), "c_custkey").sort_limit_by(3, F.desc("o_totalprice"), "o_orderkey").collect("o_orderkey"), unique="c_custkey")
    return top.map(c_custkey="c_custkey", c_name="c_name", v="array_join(cast(values as array<string>), ',')")


@query("""select r_regionkey, (select count(*) from nation a where a.n_regionkey = r_regionkey and
exists (select 1 from nation b where b.n_regionkey = r_regionkey and b.n_nationkey = a.n_nationkey + 5)) as n from region""")
def apply_join_semi(t):
    nations = t.nation.df.select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")

    def body(f):
        own = f.lookup(nations, "r_regionkey")
        return own.map(k="n_nationkey + 5").key_by(k="k").semi_join(own.map(k="n_nationkey").key_by(k="k")).count("n")

    return t.region.map(r_regionkey="r_regionkey").apply(body, unique="r_regionkey")


@query("""select r_regionkey, coalesce((select sum(m * m) from (select count(c_custkey) as m from nation left join customer on c_nationkey = n_nationkey
where n_regionkey = r_regionkey group by n_nationkey) x), 0)::bigint as s from region""")
def apply_nested(t):
    nations = t.nation.df.select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    customers = t.customer.df.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    inner = lambda f: f.lookup(customers, "n_nationkey").count("m")
    return t.region.map(r_regionkey="r_regionkey").apply(lambda f: f.lookup(nations, "r_regionkey").apply(inner).fold(s=("0L", "sum(m * m)")), unique="r_regionkey")


@query(f"select c_custkey, c_name, (select max(o_totalprice) from {O} where o_custkey = c_custkey) as top from customer where exists (select 1 from {O} where o_custkey = c_custkey)")
def apply_parallel(t):
    """The degree of parallelism changes nothing."""
    return _customers(t).apply_parallel(2, lambda f: f.lookup(_orders(t, "o_totalprice"), "c_custkey").reduce(top="max(o_totalprice)"), unique="c_custkey")


@query("select x, 3::bigint as n from (select n_regionkey as x from nation)")
def apply_duplicates(t):
    return t.nation.map(x="n_regionkey").apply(lambda f: f.flat_map("sequence(1, 3)", "y").count("n"))


# -- loops ---------------------------------------------------------------------------------------------------


@query("select n_nationkey * 32 + 31 as x from nation")
def iterate_fixed(t):
    return t.nation.map(x="n_nationkey").iterate(5, lambda f: f.map(x="x * 2 + 1"))


UNTIL = "with recursive w(id, x, i) as (select p_partkey, p_partkey, 0 from part union all select id, x // 2, i + 1 from w where x % 2 = 0 and i < 6) "


@query(UNTIL + "select id, x from w where x % 2 = 1 or i = 6")
def iterate_until(t):
    return t.part.map(id="p_partkey", x="p_partkey").iterate_until(IterCondition(6, "x % 2 = 1"), lambda f: f.map(id="id", x="x div 2"))


@query(UNTIL + "select id, x from w")
def iterate_emit_before(t):
    return t.part.map(id="p_partkey", x="p_partkey").iterate_emit_until(IterCondition(6, "x % 2 = 1"), EmitKind.BEFORE, lambda f: f.map(id="id", x="x div 2"))


@query(UNTIL + "select id, x from w where i > 0 or x % 2 = 1")
def iterate_emit_after(t):
    return t.part.map(id="p_partkey", x="p_partkey").iterate_emit_until(IterCondition(6, "x % 2 = 1"), EmitKind.AFTER, lambda f: f.map(id="id", x="x div 2"))


@query("select n_nationkey + 9 as x from nation")
def iterate_nested(t):
    return t.nation.map(x="n_nationkey").iterate(3, lambda f: f.iterate(3, lambda g: g.map(x="x + 1")))


@query("select 1::bigint as x union all select 2 union all select 3")
def iterate_dedup_per_round(t):
    """Duplicates within a round go, not those of earlier rounds."""
    return t.nation.map(x="cast(n_regionkey % 3 + 1 as bigint)").iterate(2, lambda f: f.merge(f).dedup())


@query("select n_nationkey + 3 as x from nation where n_nationkey > 0")
def iterate_apply(t):
    body = lambda f: f.apply(lambda g: g.flat_map("sequence(1, x)", "y").count("n")).map(x="cast(n + 1 as int)")
    return t.nation.filter("n_nationkey > 0").map(x="n_nationkey").iterate(3, body)


@query("select n_nationkey as x, 8::bigint as n from nation")
def apply_iterate(t):
    return t.nation.map(x="n_nationkey").apply(lambda f: f.iterate(3, lambda g: Flow(g.df.select(g.scope, F.explode(F.sequence(F.col("x"), F.col("x") + 1)).alias("x")), g.scope)).count("n"), unique="x")


PING_PONG = "with recursive w(x, k, b) as (select 3::bigint, 0, true union all select case when x % 10 <> 0 and k < 4 then x + 3 else x * 2 end, case when x % 10 <> 0 and k < 4 then k + 1 else 0 end, not (x % 10 <> 0 and k < 4) from w where not (b and x > 150)) "


@query(PING_PONG + "select x from w where b and x > 150")
def ping_pong(t):
    """A loop in a loop: up by 3 until a number ends in 0 (four times at most), then with its copy to their sum, until it is over 150."""
    inner = lambda f: f.iterate_until(IterCondition(4, "x % 10 = 0"), lambda g: g.map(x="x + 3"))

    def outer(f):
        a, b = inner(f).copied()
        return a.merge(b).reduce(x="sum(x)").into_flow()

    return t.region.limit(1).map(x="3L").iterate_until(IterCondition(20, "x > 150"), outer, every=1)


# -- graphs --------------------------------------------------------------------------------------------------

#: Suppliers and the parts they ship, both ways; parts are numbered after 10**11.
EDGES = "select distinct l_suppkey as src, l_partkey + 100000000000 as dst from lineitem"
BOTH = f"with e as ({EDGES} union all select dst, src from ({EDGES}) b) "


def _edges(t, both: bool = True) -> DataFrame:
    one = t.lineitem.df.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000000000).alias("dst")).distinct()
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if both else one


def _starts(t) -> DataFrame:
    return t.supplier.df.select(F.col("s_suppkey").alias("id"))


@query(BOTH + "select s_suppkey as id, dst as neighbor from supplier join e on src = s_suppkey")
def graph_neighbors(t):
    return graph.neighbors(_edges(t), _starts(t))


@query(BOTH + "select src, count(*) as degree from e group by 1")
def degree(t):
    return graph.count_neighbors(_edges(t))


@query(f"with e as ({EDGES}) select (select count(*) from (select src from e union select dst from e) v) as total_vertices, count(*) as total_edges from e")
def graph_totals(t):
    return graph.totals(_edges(t, False))


WALKS = """(with w1 as (select src as id, count(*) as n from e group by 1), w2 as (select src as id, sum(n) as n from e join w1 on w1.id = dst group by 1)
select src as id, sum(n)::bigint as walks from e join w2 on w2.id = dst group by 1) w"""


@query(BOTH + "select s_suppkey as id, b.dst as neighbor from supplier join e a on a.src = s_suppkey join e b on b.src = a.dst")
def khop_walks(t):
    return graph.k_hop(_edges(t), _starts(t), 2)


@query(BOTH + f"select coalesce(sum(walks), 0)::bigint as walks from {WALKS} where id = 2")
def khop_single(t):
    return graph.k_hop_counts(_edges(t), _starts(t).where("id = 2"), 3).select("walks")


@query(BOTH + f"select id, walks from supplier join {WALKS} on id = s_suppkey")
def khop_packed(t):
    return graph.k_hop_counts(_edges(t), _starts(t), 3, keep_zero=False)


@query(BOTH + f"select s_suppkey as id, coalesce(walks, 0)::bigint as walks from supplier left join {WALKS} on id = s_suppkey")
def khop_unpacked(t):
    """A subtask for each start; walks that meet at a vertex go on as one row with their number."""
    step = _edges(t).select(F.col("src").alias("x"), F.col("dst").alias("y"))

    def hop(f):
        return f.lookup(step, "x").key_by(x="y").reduce_by_key(n="sum(n)")

    last = graph.count_neighbors(_edges(t)).withColumnRenamed("src", "x")  # the last hop is only counted
    return Flow(_starts(t)).apply(lambda f: f.map(x="id", n="1L").iterate(2, hop).lookup(last, "x").fold(walks=("0L", "sum(n * degree)")), unique="id")


@query(BOTH + "select s_suppkey as id, count(distinct src)::bigint as walks from supplier left join e on src = s_suppkey group by 1")
def khop_unpacked_limit(t):
    """One row of each hop, for each start."""
    step = _edges(t).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    hop = lambda f: f.lookup(step, "x").map(x="y").sort_limit(1, "x")
    return Flow(_starts(t)).apply(lambda f: f.map(x="id").iterate(3, hop).count("walks"), unique="id")


@query("select 1::bigint as walks")
def khop_packed_limit(t):
    """One row of each hop, for all starts together."""
    step = _edges(t).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    return Flow(_starts(t)).map(x="id").iterate(3, lambda f: f.lookup(step, "x").map(x="y").limit(1)).count("walks")


@query(BOTH + "select b.dst as x, (select count(*) from e c where c.src = b.dst)::bigint as n from e a join e b on a.dst = b.src where a.src = 2")
def khop_correlated(t):
    edges = _edges(t)
    ends = Flow(graph.k_hop(edges, _starts(t).where("id = 2"), 2).select(F.col("neighbor").alias("x")))
    return ends.apply(lambda f: f.lookup(edges.select(F.col("src").alias("x"), "dst"), "x").count("n"))


def _topology(t) -> DataFrame:
    live = t.customer.df.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    sell = t.supplier.df.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    return graph.labeled(live, "customer", "lives", "nation").unionAll(graph.labeled(sell, "supplier", "sells", "nation"))


@query("""select 'nation' as label, n_nationkey::bigint as id, 'lives' as edge_label, 'customer' as neighbor_label, c_custkey as neighbor from nation join customer on c_nationkey = n_nationkey 
union all select 'nation', n_nationkey, 'sells', 'supplier', s_suppkey from nation join supplier on s_nationkey = n_nationkey""")
def labeled_neighbors(t):
    starts = t.nation.df.select(F.lit("nation").alias("label"), F.col("n_nationkey").cast("long").alias("id"))
    return graph.labeled_neighbors(_topology(t), starts, graph.Direction.IN)


@query("select 'supplier' as label, s_suppkey as id, 'sells' as edge_label, 'nation' as neighbor_label, s_nationkey::bigint as neighbor from supplier")
def labeled_through(t):
    starts = t.supplier.df.select(F.lit("supplier").alias("label"), F.col("s_suppkey").alias("id"))
    return graph.labeled_neighbors(_topology(t), starts, graph.Direction.BOTH, "sells")


@query("""select 'nation' as label, n_nationkey::bigint as id, (select count(*) from customer where c_nationkey = n_nationkey) + (select count(*) from supplier where s_nationkey = n_nationkey) as degree from nation""")
def labeled_degree(t):
    starts = t.nation.df.select(F.lit("nation").alias("label"), F.col("n_nationkey").cast("long").alias("id"))
    return graph.count_all_edges(_topology(t), starts)


@query("select c_custkey as id, c_name from customer where c_custkey in (select s_suppkey from supplier) and c_acctbal > 0")
def vertex_properties(t):
    table = t.customer.map(id="c_custkey", c_name="c_name", c_acctbal="c_acctbal").df
    return graph.filter_vertex(table, t.supplier.map(id="s_suppkey").df, "c_acctbal > 0").select("id", "c_name")


@query("select n_nationkey as id, n_name from nation order by n_regionkey desc, n_name limit 7")
def vertex_order(t):
    return graph.ordered(t.nation.map(id="n_nationkey", n_name="n_name", n_regionkey="n_regionkey").df, ("n_regionkey", False), ("n_name", True)).limit(7).select("id", "n_name")


@query(BOTH + """select src as id from (select distinct src, md5('7:' || src) as h from e) x where ('0x' || substr(h, 1, 8))::bigint < 0.5 * 4294967296 order by h limit 50""")
def sample_vertices(t):
    return graph.sample_vertices(_edges(t), 50, 0.5, 7)


RANKS = BOTH + ", v as (select distinct src as id from e), o as (select src, count(*) as out from e group by 1), r0 as (select id, 1.0::double / (select count(*) from v) as rank from v)"
for _k in (1, 2, 3):
    RANKS += f", r{_k} as (select id, coalesce(0.85 * s + (1 - 0.85) / (select count(*) from v), rank) as rank from r{_k - 1} left join (select e.dst, sum(rank / out) as s from e join o on o.src = e.src join r{_k - 1} on id = e.src group by 1) g on g.dst = id)"


@query(RANKS + " select id, round(rank, 9) as rank from r3")
def pagerank_3(t):
    return algorithms.pagerank(_edges(t), 3, least_delta=None)[0].select("id", F.round("rank", 9).alias("rank"))


GRADIENTS = "with recursive s as (select o_totalprice / 400000 as a, (o_orderkey % 7) / 7.0::double as b, case when o_orderstatus = 'F' then 1.0 else 0.0 end as y from orders), w1 as (select 1.0::double as w0, 1.0::double as w1, 1.0::double as w2)"
for _k in range(1, 6):
    GRADIENTS += f", g{_k} as (select sum(1 / (1 + exp(-(w0 + w1 * a + w2 * b))) - y) as g0, sum((1 / (1 + exp(-(w0 + w1 * a + w2 * b))) - y) * a) as g1, sum((1 / (1 + exp(-(w0 + w1 * a + w2 * b))) - y) * b) as g2 from s, w{_k})"
    GRADIENTS += f", w{_k + 1} as (select w0 - g0 * 0.00001 as w0, w1 - g1 * 0.00001 as w1, w2 - g2 * 0.00001 as w2 from w{_k}, g{_k})"


@query(GRADIENTS + " select 0 as i, round(w0, 6) as w, round(g0, 3) as g from w5, g5 union all select 1, round(w1, 6), round(g1, 3) from w5, g5 union all select 2, round(w2, 6), round(g2, 3) from w5, g5")
def logreg_5(t):
    own = t.orders.map(a="o_totalprice / 400000", b="cast((o_orderkey % 7) / 7.0D as double)", y="case when o_orderstatus = 'F' then 1.0D else 0.0D end").df
    weights, last = algorithms.logistic_regression(own, ["a", "b"], "y", 5, 0.00001)
    rows = [(i, round(w, 6), round(g, 3)) for i, (w, g) in enumerate(zip(weights, last, strict=True))]
    return t.spark.createDataFrame(rows, "i int, w double, g double")


@query(BOTH + """, d1 as (select distinct dst as id from e where src = 2), d2 as (select distinct e.dst as id from e join d1 on e.src = d1.id where e.dst <> 2 and e.dst not in (select id from d1)),
d3 as (select distinct e.dst as id from e join d2 on e.src = d2.id where e.dst <> 2 and e.dst not in (select id from d1) and e.dst not in (select id from d2))
select 2::bigint as id, 0 as dist union all select id, 1 from d1 union all select id, 2 from d2 union all select id, 3 from d3""")
def bfs_levels(t):
    return algorithms.bfs(_edges(t), _starts(t).where("id = 2"), 3)


#: Suppliers that know each other: the next one, and the one of twice the number, both ways.
KNOWS = "with k as (select s_suppkey as src, s_suppkey + 1 as dst from supplier union select s_suppkey, 2 * s_suppkey from supplier), e as (select src, dst from k union select dst, src from k)"


@query(KNOWS + """, d1 as (select distinct dst as id from e where src = 2 and dst <> 2), d2 as (select distinct e.dst as id from e join d1 on e.src = d1.id where e.dst <> 2 and e.dst not in (select id from d1)),
d3 as (select distinct e.dst as id from e join d2 on e.src = d2.id where e.dst <> 2 and e.dst not in (select id from d1) and e.dst not in (select id from d2))
select id, dist, (s_nationkey % 2)::varchar as first_name, s_name as last_name from (select id, 1 as dist from d1 union all select id, 2 from d2 union all select id, 3 from d3) d join supplier on s_suppkey = id
where s_nationkey % 2 = 1 order by dist, last_name, id limit 20""")
def friends_by_name(t):
    one = t.supplier.df.select(F.col("s_suppkey").alias("src"), F.explode(F.expr("array(s_suppkey + 1, 2 * s_suppkey)")).alias("dst"))
    edges = one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    people = t.supplier.map(id="s_suppkey", first_name="cast(s_nationkey % 2 as string)", last_name="s_name").df
    return algorithms.friends_by_name(edges, people, 2, "1", 3).select("id", "dist", "first_name", "last_name")


@query("select 499500::bigint as n")
def flow_control(t):
    return input_range(t.spark, 0, 1000).flat_map("sequence(0, x)", "y", ["x"]).filter("y < x").count("n")


# -- sources, sinks, jobs -----------------------------------------------------------------------------------


def _scratch(t) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


@query("select n_nationkey as x from nation")
def sink_rows(t):
    """Rows into a list, a partition at a time, and back."""
    rows: list = []
    t.nation.map(x="n_nationkey").sink_into(rows)
    return input_from(t.spark, rows, "x int")


@query("select count(*) as n, max(o_totalprice) as m from orders")
def sink_single(t):
    return input_from(t.spark, [t.orders.reduce(n="count(*)", m="max(o_totalprice)").sink()], "n long, m double")


@query("select r_regionkey as x, 0 as failed from region union all select -1, 1")
def result_stream(t):
    """A job's rows one by one; an error goes its own way, once, and ends the stream."""
    rows = [(r["x"], 0) for r in job.run(t.spark, lambda spark, conf: t.region.map(x="r_regionkey"))]
    errors: list = []
    broken = job.run(t.spark, lambda spark, conf: t.region.map(x="raise_error('no')"), on_error=errors.append)
    assert list(broken) == [] and broken.try_next() is None
    return input_from(t.spark, [*rows, *((-1, 1) for _ in errors)], "x int, failed int")


@query("select r_regionkey + 10 as x from region")
def job_by_name(t):
    """A program that is registered under a name, with an argument and a resource."""
    programs = job.Registry()

    @programs.register("shifted")
    def shifted(spark, conf, by):
        return conf.resources["regions"].map(x=F.col("r_regionkey") + by)

    return input_from(t.spark, list(programs.submit(t.spark, "shifted", job.JobConf(resources={"regions": t.region}), by=10)), "x int")


@query("select distinct l_suppkey as src, l_partkey as dst from lineitem")
def edges_encode(t):
    """Edges written as text with a header and a separator, encoded, and loaded."""
    return _encoded(t)


@query("select distinct l_suppkey as src, l_partkey as dst from lineitem where l_suppkey % 3 = 1")
def edges_partition(t):
    """The encoded edges of one of three parts."""
    return _encoded(t, (1, 3))


def _encoded(t, part=None) -> DataFrame:
    at = _scratch(t)
    t.lineitem.df.select("l_suppkey", "l_partkey").distinct().write.option("sep", "|").option("header", True).csv(f"{at}/text")
    encode_edges(t.spark, f"{at}/text", f"{at}/edges", "|", skip_header=True, partition=part)
    return load_edges(t.spark, f"{at}/edges")


@query("select l_suppkey as src, count(distinct l_partkey) as n, 1::bigint as workers from lineitem group by 1")
def edges_by_source(t):
    """All edges of a source are with one worker."""
    own = partition_edges(t.lineitem.df.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(), 4)
    return own.withColumn("worker", worker_index()).groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("worker").alias("workers"))


@query("select c_custkey as id, c_name from customer where c_custkey in (select s_suppkey from supplier)")
def property_reader(t):
    at = _scratch(t)
    t.customer.map(id="c_custkey", c_name="c_name", c_acctbal="c_acctbal").write(f"{at}/vertices")
    return properties(t.spark, f"{at}/vertices", t.supplier.map(id="s_suppkey").df, ["c_name"])


@query("select n_name as line from nation")
def lines_of_text(t):
    at = _scratch(t)
    t.nation.map(value="n_name").df.write.text(at)
    return text_lines(t.spark, at)


@query("select n_nationkey, n_name from nation")
def delimited_file(t):
    at = _scratch(t)
    t.nation.map(n_nationkey="n_nationkey", n_name="n_name").df.write.option("sep", ";").option("header", True).csv(at)
    return delimited(t.spark, at, "n_nationkey int, n_name string", ";")


@query("select n_nationkey as x from nation union all select n_nationkey from nation")
def source_replicas(t):
    """A source that two workers read."""
    return input_from(t.spark, [r["x"] for r in t.nation.map(x="n_nationkey").df.collect()], "x int", replicas=2)


@query("select x, (x * x)::bigint as y from range(0, 1000) r(x)")
def source_of_own(t):
    """A source that a program brings along, read in four tasks."""
    return own_source(t.spark, "squares", "x long, y long", [(k * 250, k * 250 + 250) for k in range(4)], lambda part: ((x, x * x) for x in range(*part)))


@query("select c_custkey as id, 'segment ' || lower(c_mktsegment) as segment from customer")
def resource_in_tasks(t):
    """A value of the job's, looked up by a function that runs in tasks."""
    names = {r["c_mktsegment"]: f"segment {r['c_mktsegment'].lower()}" for r in t.customer.map(c_mktsegment="c_mktsegment").dedup().df.collect()}
    conf = job.JobConf(resources={"names": names})

    def program(spark, conf):
        table = conf.in_tasks(spark, "names")

        def rename(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([table.value[x] for x in b.column(1).to_pylist()], pa.string())], names=["id", "segment"])

        return t.customer.map(id="c_custkey", c_mktsegment="c_mktsegment").map_arrow(rename, "id long, segment string")

    return program(t.spark, conf)


entry = partial(QUERIES["word_count"])
