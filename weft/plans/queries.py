"""The registered queries. Money is summed as decimals, so that no order of rows matters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft import io, stats, types
from weft.artifact import Artifact, literal
from weft.formats import Parquet
from weft.functions import components, fold_xor, vectorised
from weft.graph import Graph, GraphSnapshot
from weft.operators.joins import asof_join, range_join, top_k
from weft.partitions import DateField, PartitionKey
from weft.plans.graphs import built, each, event_keys, events_by, made, output, raw, table
from weft.session import fresh_dir
from weft.sources import SparkFile
from weft.sources.base import DEFAULT
from weft.streaming import run_available, session_windows, sliding, tumbling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return keep


def money(x: str | Column) -> Column:
    return F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)")).cast("double")


def over(name: str, tables: list[str], sql: str) -> Callable[[Callable], Query]:
    """A query of one producer over whole tables."""

    def keep(build: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return built(spark, sf_dir, name, tables, build)

        run.__name__ = name
        return query(sql)(run)

    return keep


# Graphs


@over("spend_total", ["events"], "select cast(sum(cast(value as decimal(18,2))) as double) as total from events")
def _(events: DataFrame) -> DataFrame:
    return events.agg(money("value").alias("total"))


def _by_day(spark: SparkSession, sf_dir: str, build: Callable, name: str = "by_day") -> GraphSnapshot:
    root = fresh_dir(spark)
    events = table(spark, sf_dir, "events")
    with Graph(name) as g:
        events_by(spark, sf_dir, g, event_keys(), {"day": types.Date()}, root)
        schema = build(events=events.withColumns(event_keys())).schema
        t = types.Collection(element=types.Struct(fields={**types.from_spark(schema).fields, "day": types.Date()}), partition_by=("day",))
        day = made(f"{name}_each", build, ["events"], map=each("events"), one_job=True)
        g.artifacts.days = day(events=g.artifacts.events).out(Artifact(type=t, format=Parquet(), storage=SparkFile(path=f"{root}/{DEFAULT}")))
    return g.build()


def _spend_of_day(events: DataFrame) -> DataFrame:
    return events.groupBy("day").agg(F.count(F.lit(1)).alias("n"), money("value").alias("spend"))


@query("select cast(ts as date) as day, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as spend from events group by 1")
def spend_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = _by_day(spark, sf_dir, _spend_of_day)
    return snapshot.read(snapshot.artifacts.days, DataFrame)


@over(
    "partition_components",
    ["events"],
    """select distinct cast(year(ts) as integer) as y, cast(month(ts) as integer) as m, cast(day(ts) as integer) as d, strftime(ts, '%Y-%m-%d') as iso, user_id as value,
    case when user_id < 0 then '-0x' else '0x' end || lower(printf('%x', abs(user_id))) as hex from events""",
)
def _(events: DataFrame) -> DataFrame:
    day, user = components(F.to_date("ts"), types.Date()), components(F.col("user_id"), types.Int64())
    return events.select(day["Y"].alias("y"), day["m"].alias("m"), day["d"].alias("d"), day["iso"].alias("iso"), F.col("user_id").alias("value"), user["hex"].alias("hex")).distinct()


@query("select event_id, user_id, value from events where cast(ts as date) = (select min(cast(ts as date)) from events)")
def partition_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixed day's partition: its path alone is listed and read."""
    snapshot = _by_day(spark, sf_dir, _spend_of_day)
    whole = snapshot.artifacts.events
    first = min(s.key["day"].value for s in snapshot.partitions(whole))
    fixed = whole.storage.path
    for part, value in (("Y", first.year), ("m", first.month), ("d", first.day)):
        fixed = fixed.replace(f"{{day.{part}", f"{{day.{part}[{value:0{2 if part != 'Y' else 4}}]")
    one = SparkFile(path=fixed).of_type(whole.type)
    return io.read(whole.type, whole.format, one.discover(), io.FrameView).select("event_id", "user_id", "value")


@query("select cast(ts as date) as day, count(*) as n from events group by 1")
def partition_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What discovery finds, with the rows of each partition."""
    snapshot = _by_day(spark, sf_dir, _spend_of_day)
    whole = snapshot.artifacts.events
    found = whole.storage.discover()
    days = spark.createDataFrame([(s.key["day"].value,) for s in found], "day date")
    rows = io.read(whole.type, whole.format, found, io.FrameView).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.join(rows, "day")


@query("select cast(ts as date) as day, cast(user_id % 4 as integer) as shard, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as spend from events group by 1, 2")
def multi_key_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, keys = fresh_dir(spark), {**event_keys(), "shard": F.pmod("user_id", F.lit(4)).cast("int")}
    with Graph("two_keys") as g:
        events_by(spark, sf_dir, g, keys, {"day": types.Date(), "shard": types.Int32()}, root)
    snapshot = g.build()
    return snapshot.read(snapshot.artifacts.events, DataFrame).groupBy("day", "shard").agg(F.count(F.lit(1)).alias("n"), money("value").alias("spend"))


def _with_literal(spark: SparkSession, sf_dir: str, name: str, value: object, build: Callable) -> DataFrame:
    """A table and a literal, which the producer takes as a plain value."""
    import inspect
    from typing import Annotated

    from weft.producer import producer

    root, events = fresh_dir(spark), table(spark, sf_dir, "events")

    def run(events: DataFrame, limit: object) -> DataFrame:
        return build(events, limit)

    run.__annotations__ = {"events": Annotated[DataFrame, Artifact], "limit": Annotated[type(value), Artifact], "return": Annotated[DataFrame, Artifact]}
    run.__signature__ = inspect.signature(run)  # type: ignore[attr-defined]
    with Graph(name) as g:
        g.artifacts.events, g.artifacts.limit = raw(spark, sf_dir, "events"), literal(value)
        g.artifacts.out = producer(name=name)(run)(events=g.artifacts.events, limit=g.artifacts.limit).out(output(spark, root, build(events, value).schema))
    snapshot = g.build()
    return snapshot.read(snapshot.artifacts.out, DataFrame)


@query("select event_id, value from events where value > 50.0")
def literal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_literal(spark, sf_dir, "literal_threshold", 50.0, lambda events, limit: events.where(F.col("value") > limit).select("event_id", "value"))


@query("select event_id, event_type from events where event_type in ('click', 'purchase', 'view')")
def literal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_literal(spark, sf_dir, "literal_list", ["click", "purchase", "view"], lambda events, limit: events.where(F.col("event_type").isin(limit)).select("event_id", "event_type"))


@over("multi_input_join", ["orders", "customer"], "select c_mktsegment as segment, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders join customer on o_custkey = c_custkey group by 1")
def _(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total"))


@query("select 'big' as side, o_orderkey from orders where o_totalprice >= 100000 union all select 'small', o_orderkey from orders where not o_totalprice >= 100000")
def multi_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark)
    big = F.col("o_totalprice") >= 100000

    def split(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
        return orders.where(big).select("o_orderkey"), orders.where(~big).select("o_orderkey")

    schema = table(spark, sf_dir, "orders").select("o_orderkey").schema
    with Graph("split") as g:
        g.artifacts.orders = raw(spark, sf_dir, "orders")
        g.artifacts.big, g.artifacts.small = made("split", split, ["orders"], outputs=2)(orders=g.artifacts.orders).out(output(spark, root, schema), output(spark, root, schema))
    s = g.build()
    return s.read(s.artifacts.big, DataFrame).select(F.lit("big").alias("side"), "o_orderkey").unionByName(s.read(s.artifacts.small, DataFrame).select(F.lit("small").alias("side"), "o_orderkey"))


@query("with c as (select o_custkey, count(*) as n from orders group by 1) select n as orders, count(*) as customers from c group by 1")
def producer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark)

    def count(orders: DataFrame) -> DataFrame:
        return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    def spread(counts: DataFrame) -> DataFrame:
        return counts.groupBy(F.col("n").alias("orders")).agg(F.count(F.lit(1)).alias("customers"))

    first = count(table(spark, sf_dir, "orders"))
    with Graph("chain") as g:
        g.artifacts.orders = raw(spark, sf_dir, "orders")
        g.artifacts.counts = made("count", count, ["orders"])(orders=g.artifacts.orders).out(output(spark, root, first.schema))
        g.artifacts.spread = made("spread", spread, ["counts"])(counts=g.artifacts.counts).out(output(spark, root, spread(first).schema))
    s = g.build()
    return s.read(s.artifacts.spread, DataFrame)


@query("select l_returnflag as flag, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from lineitem group by 1")
def validated_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(lineitem: DataFrame) -> DataFrame:
        return lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(money("l_quantity").alias("quantity"))

    def valid(out: DataFrame) -> tuple[bool, str]:
        found = stats.broken(out, [stats.Threshold(statistic=stats.Min(field="quantity"), low=0)])
        return not found, "; ".join(found)

    return built(spark, sf_dir, "validated", ["lineitem"], build, validate_outputs=valid)


@query("select count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as spend from events")
def snapshot_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result as it was when it was tagged, after the raw data changed."""
    root, events = fresh_dir(spark), table(spark, sf_dir, "events")
    total = lambda events: events.agg(F.count(F.lit(1)).alias("n"), money("value").alias("spend"))
    here = f"{root}/raw.parquet"
    events.write.parquet(here)
    with Graph("reread") as g:
        g.artifacts.events = Artifact(type=types.collection_of(events), format=Parquet(), storage=SparkFile(path=here))
        g.artifacts.out = made("total", total, ["events"])(events=g.artifacts.events).out(output(spark, root, total(events).schema))
    g.build().tag("first")
    events.where("event_id % 2 = 0").write.mode("overwrite").parquet(here)
    g.build()
    old = GraphSnapshot.from_tag("reread", "first", g.backend)
    return old.read(old.artifacts.out, DataFrame)


def each_of(made: int, days: int) -> int:
    """Builds of each day; their plain number where that isn't whole, so that no build too many is rounded away."""
    return made // days if made % days == 0 else made


@query("select * from (values ('first build', 1), ('again', 0), ('changed', 1), ('changed back', 0), ('new day', 1)) t(step, builds)")
def incremental_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many partitions each build makes: none where nothing is missing."""
    root, days = fresh_dir(spark), table(spark, sf_dir, "events").withColumns(event_keys())
    t = types.Collection(element=types.Struct(fields={"day": types.Date(nullable=True), "event_id": types.Int64(nullable=True), "value": types.Float64(nullable=True)}), partition_by=("day",))
    first, *rest = (r.day for r in days.select("day").distinct().orderBy("day").collect())
    *rest, last = rest
    builds = spark.sparkContext.accumulator(0)

    def build(raw: DataFrame) -> DataFrame:
        builds.add(1)
        return raw.groupBy("day").agg(F.count(F.lit(1)).alias("event_id"), money("value").alias("value"))

    storage = SparkFile(path=f"{root}/raw/{{day.iso}}.parquet")

    def put(day: object, odd: bool = False) -> None:
        rows = days.where(F.col("day") == F.lit(day)).where("event_id % 2 = 1" if odd else "true").select("event_id", "value")
        io.write(rows.withColumn("day", F.lit(day)), t, Parquet(), storage.of_type(t).partition(PartitionKey(day=DateField(value=day))), io.FrameView)

    for day in (first, *rest):
        put(day)
    with Graph("incremental") as g:
        g.artifacts.raw = Artifact(type=t, format=Parquet(), storage=storage)
        g.artifacts.days = made("day", build, ["raw"], map=each("raw"))(raw=g.artifacts.raw).out(Artifact(type=t, format=Parquet(), storage=SparkFile(path=f"{root}/{DEFAULT}")))
    out, seen = [], 0

    def step(name: str, per: int = 1) -> None:
        nonlocal seen
        g.build()
        out.append((name, each_of(builds.value - seen, per)))
        seen = builds.value

    step("first build", 1 + len(rest))
    step("again")
    put(first, odd=True)
    step("changed")
    put(first)
    step("changed back")
    put(last)
    step("new day")
    return spark.createDataFrame(out, "step string, builds int")


@over(
    "type_cast_matrix",
    ["lineitem"],
    """select l_orderkey, l_linenumber, cast(l_linenumber as tinyint) as int8, cast(l_linenumber as smallint) as int16, cast(l_orderkey as bigint) as int64, cast(l_quantity as float) as float32,
    l_quantity as float64, cast(l_shipdate as date) as day, l_returnflag = 'R' as returned, cast(l_orderkey as varchar) as text from lineitem""",
)
def _(lineitem: DataFrame) -> DataFrame:
    t = types.Collection(element=types.Struct(fields={"l_orderkey": types.Int64(nullable=True), "l_linenumber": types.Int32(nullable=True), "int8": types.Int8(nullable=True), "int16": types.Int16(nullable=True), "int64": types.Int64(nullable=True), "float32": types.Float32(nullable=True), "float64": types.Float64(nullable=True), "day": types.Date(nullable=True), "returned": types.Boolean(nullable=True), "text": types.String(nullable=True)}))
    return types.conform(lineitem.withColumns({"int8": F.col("l_linenumber"), "int16": F.col("l_linenumber"), "int64": F.col("l_orderkey"), "float32": F.col("l_quantity"), "float64": F.col("l_quantity"), "day": F.to_date("l_shipdate"), "returned": F.col("l_returnflag") == "R", "text": F.col("l_orderkey")}), t)


@over(
    "nested_types",
    ["lineitem"],
    """select l_orderkey as k, count(*) as lines, count(distinct l_returnflag) as flags, min(l_linenumber) as first_line, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from lineitem group by 1""",
)
def _(lineitem: DataFrame) -> DataFrame:
    """A list, a set, a map and a struct for each order, taken apart again."""
    nested = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.collect_list(F.col("l_quantity").cast("decimal(18,2)")).alias("quantities")
    )
    nested = nested.withColumn("by_line", F.map_from_arrays(F.sequence(F.lit(1), F.size("quantities")), "quantities"))
    total = F.aggregate(F.map_values("by_line"), F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x).cast("decimal(28,2)"))
    return nested.select("k", F.size("lines").cast("long").alias("lines"), F.size("flags").cast("long").alias("flags"), F.array_min(F.transform("lines", lambda x: x["l_linenumber"])).alias("first_line"), total.cast("double").alias("quantity"))


@over("enum_check", ["orders"], "select count_if(o_orderstatus not in ('F', 'O')) as outside, count(*) as n from orders")
def _(orders: DataFrame) -> DataFrame:
    status = types.Enum(type=types.String(), items=["F", "O"], nullable=True)
    return orders.agg(F.count_if(types.bad(status, F.col("o_orderstatus"))).alias("outside"), F.count(F.lit(1)).alias("n"))


@over("fingerprint_xor", ["orders"], "select o_orderstatus as status, cast(bit_xor(o_orderkey) as bigint) as folded from orders group by 1")
def _(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_orderstatus").alias("status")).agg(fold_xor(F.col("o_orderkey")).alias("folded"))


@over("field_statistics", ["part"], "select count(*) as count, count(distinct p_brand) as countdistinct_p_brand, max(p_size) as max_p_size, min(p_size) as min_p_size, cast(sum(p_size) as bigint) as sum_p_size from part")
def _(part: DataFrame) -> DataFrame:
    return stats.frame(part, [stats.Count(), stats.CountDistinct(field="p_brand"), stats.Max(field="p_size"), stats.Min(field="p_size"), stats.Sum(field="p_size")])


# Relational extensions in producers' bodies

def _join(how: str) -> Callable:
    def build(customer: DataFrame, orders: DataFrame) -> DataFrame:
        few = orders.where(F.col("o_totalprice") > 200000).select("o_orderkey", "o_custkey")
        some = customer.where(F.col("c_acctbal") > 0).select("c_custkey", "c_name")
        return some.join(few, F.col("c_custkey") == F.col("o_custkey"), how)

    return build


_SIDES = "with c as (select c_custkey, c_name from customer where c_acctbal > 0), o as (select o_orderkey, o_custkey from orders where o_totalprice > 200000) "
for _name, _how, _sql in (
    ("inner", "inner", "select * from c join o on c_custkey = o_custkey"),
    ("left", "left", "select * from c left join o on c_custkey = o_custkey"),
    ("right", "right", "select * from c right join o on c_custkey = o_custkey"),
    ("full", "full", "select * from c full join o on c_custkey = o_custkey"),
    ("semi", "left_semi", "select * from c where exists (select 1 from o where o_custkey = c_custkey)"),
    ("anti", "left_anti", "select * from c where not exists (select 1 from o where o_custkey = c_custkey)"),
):
    over(f"ext_join_{_name}", ["customer", "orders"], _SIDES + _sql)(_join(_how))


@over("ext_join_range", ["part", "supplier"], "select p_partkey, s_suppkey from part join supplier on p_retailprice between s_acctbal - 5 and s_acctbal + 5")
def _(part: DataFrame, supplier: DataFrame) -> DataFrame:
    bounds = supplier.select("s_suppkey", (F.col("s_acctbal") - 5).alias("low"), (F.col("s_acctbal") + 5).alias("high"))
    return range_join(part.select("p_partkey", "p_retailprice"), bounds, "p_retailprice", "low", "high", 10).select("p_partkey", "s_suppkey")


@over(
    "ext_join_asof",
    ["events"],
    """with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select event_id as seen_id, user_id as u, ts as at from events where event_type <> 'purchase')
    select p.event_id, p.user_id, max_by(v.seen_id, (v.at, v.seen_id)) as seen_id from p left join v on p.user_id = v.u and v.at <= p.ts group by 1, 2""",
)
def _(events: DataFrame) -> DataFrame:
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type <> 'purchase'").select(F.col("event_id").alias("seen_id"), "user_id", "ts")
    return asof_join(bought, seen, ["user_id"], "ts", "ts", ["seen_id"]).select("event_id", "user_id", "seen_id")


@over("ext_agg_distinct", ["lineitem"], "select l_returnflag as flag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


_GROUPED = "select l_returnflag as flag, l_linestatus as status, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from lineitem group by "


def _grouped(kind: str) -> Callable:
    def build(lineitem: DataFrame) -> DataFrame:
        rows = lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
        flag, status = F.col("flag"), F.col("status")
        found = {"rollup": lambda: rows.rollup("flag", "status"), "cube": lambda: rows.cube("flag", "status"), "sets": lambda: rows.groupingSets([[flag], [status]], flag, status)}[kind]()
        return found.agg(F.count(F.lit(1)).alias("n"), money("l_quantity").alias("quantity")).select("flag", "status", "n", "quantity")

    return build


over("ext_rollup", ["lineitem"], _GROUPED + "rollup (l_returnflag, l_linestatus)")(_grouped("rollup"))
over("ext_cube", ["lineitem"], _GROUPED + "cube (l_returnflag, l_linestatus)")(_grouped("cube"))
over("ext_grouping_sets", ["lineitem"], _GROUPED + "grouping sets ((l_returnflag), (l_linestatus))")(_grouped("sets"))


@over("ext_window_rank", ["orders"], "select o_orderkey, cast(rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as integer) as place, cast(ntile(4) over (partition by o_custkey order by o_orderkey) as integer) as quarter from orders")
def _(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return orders.select("o_orderkey", F.rank().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"), F.ntile(4).over(w.orderBy("o_orderkey")).alias("quarter"))


@over("ext_window_frame", ["orders"], "select o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as double) as rolling, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders")
def _(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(-2, 0)).cast("double").alias("rolling"), F.lag("o_orderkey").over(w).alias("before"))


@over("ext_topk", ["orders"], "select o_custkey, o_orderkey, k as rank from (select *, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as integer) as k from orders) where k <= 3")
def _(orders: DataFrame) -> DataFrame:
    return top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@over("ext_sort_limit", ["orders"], "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def _(orders: DataFrame) -> DataFrame:
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


_TWO = "(select o_custkey as k from orders where o_totalprice > 150000) {} (select c_custkey from customer where c_acctbal > 0)"


def _sets(how: str) -> Callable:
    def build(orders: DataFrame, customer: DataFrame) -> DataFrame:
        a = orders.where(F.col("o_totalprice") > 150000).select(F.col("o_custkey").alias("k"))
        b = customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k"))
        return getattr(a, how)(b)

    return build


for _name, _how, _sql in (("union", "unionByName", "union all"), ("intersect", "intersect", "intersect"), ("except", "exceptAll", "except all")):
    over(f"ext_{_name}", ["orders", "customer"], _TWO.format(_sql))(_sets(_how))


@over("ext_scalar_string", ["part"], "select p_partkey, upper(p_name) as up, length(p_name) as n, substr(p_brand, 1, 5) as head, replace(p_type, ' ', '_') as flat, concat(p_brand, '/', p_type) as both, lpad(cast(p_size as varchar), 4, '0') as padded, regexp_replace(p_name, '[aeiou]', '', 'g') as bare from part")
def _(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.upper("p_name").alias("up"), F.length("p_name").cast("long").alias("n"), F.substring("p_brand", 1, 5).alias("head"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("flat"), F.concat("p_brand", F.lit("/"), "p_type").alias("both"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.regexp_replace("p_name", "[aeiou]", "").alias("bare"))


@over("ext_scalar_date", ["orders"], "select o_orderkey, cast(o_orderdate as date) as day, cast(year(o_orderdate) as integer) as y, cast(quarter(o_orderdate) as integer) as q, cast(date_trunc('month', o_orderdate) as date) as month, cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as integer) as since, cast(cast(o_orderdate as date) + 30 as date) as due from orders")
def _(orders: DataFrame) -> DataFrame:
    day = F.to_date("o_orderdate")
    return orders.select("o_orderkey", day.alias("day"), F.year(day).alias("y"), F.quarter(day).alias("q"), F.trunc(day, "month").alias("month"), F.datediff(day, F.lit("1990-01-01").cast("date")).alias("since"), F.date_add(day, 30).alias("due"))


@over("ext_scalar_math", ["part"], "select p_partkey, abs(p_size - 25) as off, p_size % 7 as rest, cast(floor(p_retailprice / 10) as bigint) as tens, cast(ceil(p_retailprice / 10) as bigint) as up, sqrt(p_size * p_size) as root, greatest(p_size, 10) as most, cast(sign(p_size - 25) as integer) as side from part")
def _(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return part.select("p_partkey", F.abs(size - 25).alias("off"), (size % 7).alias("rest"), F.floor(F.col("p_retailprice") / 10).alias("tens"), F.ceil(F.col("p_retailprice") / 10).alias("up"), F.sqrt(size * size).alias("root"), F.greatest(size, F.lit(10)).alias("most"), F.signum(size - 25).cast("int").alias("side"))


@over("ext_scalar_array", ["embeddings"], "select vec_id, len(embedding) as n, embedding[1] as first, list_max(embedding) as most, len(list_filter(embedding, lambda x: x > 0)) as positive from embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    v = F.col("embedding")
    return embeddings.select("vec_id", F.size(v).cast("long").alias("n"), v[0].alias("first"), F.array_max(v).alias("most"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"))


@over("ext_scalar_map", ["events"], "select user_id, event_type, count(*) as n from events group by 1, 2")
def _(events: DataFrame) -> DataFrame:
    """A map of counts for each user, exploded again."""
    counts = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("event_type", "n"))


@over("ext_scalar_json", ["events"], "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@over("ext_subquery", ["orders", "customer"], "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer where c_acctbal > (select avg(c_acctbal) from customer)")
def _(orders: DataFrame, customer: DataFrame) -> DataFrame:
    orders.createOrReplaceTempView("weft_orders")
    customer.createOrReplaceTempView("weft_customer")
    return orders.sparkSession.sql("select c_custkey, (select count(*) from weft_orders where o_custkey = c_custkey) as n from weft_customer where c_acctbal > (select avg(c_acctbal) from weft_customer)")


def _aggregates() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), money("value").alias("spend")]


@over("ext_tumbling", ["events"], "select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as spend from events group by 1, 2, 3")
def _(events: DataFrame) -> DataFrame:
    return tumbling(events, "ts", "1 hour", _aggregates(), ["event_type"])


@over("ext_sliding", ["events"], "with w as (select e.*, date_trunc('hour', ts) - to_hours(k) as s from events e, (values (0), (1), (2)) t(k)) select s as window_start, s + interval 3 hour as window_end, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as spend from w group by 1, 2")
def _(events: DataFrame) -> DataFrame:
    return sliding(events, "ts", "3 hours", "1 hour", _aggregates())


@over(
    "ext_session",
    ["events"],
    """with a as (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as fresh from events),
    b as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from a)
    select min(ts) as window_start, max(ts) + interval 6 hour as window_end, user_id, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as spend from b group by user_id, s""",
)
def _(events: DataFrame) -> DataFrame:
    return session_windows(events, "ts", "6 hours", _aggregates(), ["user_id"])


@query(
    """with t as (select max(ts) as last, date_trunc('day', max(ts)) as newest, date_trunc('day', min(ts) + (max(ts) - min(ts)) / 2) as middle from events)
    select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as spend
    from events, t where ts >= middle and date_trunc('hour', ts) + interval 1 hour <= last - interval 10 minute group by 1, 2, 3"""
)
def ext_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream with a watermark of ten minutes, in three batches: those from the middle day on, the newest day, and
    then the first half, which comes too late for its windows. Windows that the watermark hasn't passed stay open. Watermarks need instants, so clock
    times are read, and given back, in the session's zone."""
    events, root = table(spark, sf_dir, "events"), fresh_dir(spark)
    t = events.agg(F.max("ts").alias("last"), F.date_trunc("day", F.max("ts")).alias("newest"), F.date_trunc("day", F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("middle")).first()
    ts = F.col("ts")
    parts = [(ts >= t.middle) & (ts < t.newest), ts >= t.newest, ts < t.middle]
    out = events
    for part in parts:  # each run takes what arrived since the last one, from its checkpoint
        events.where(part).write.mode("append").parquet(f"{root}/arrived")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/arrived").withColumn("ts", ts.cast("timestamp"))
        out = run_available(tumbling(stream, "ts", "1 hour", _aggregates(), ["event_type"], delay="10 minutes"), f"{root}/out", f"{root}/state")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@over("ext_udf_vectorised", ["lineitem"], "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    net = vectorised.scalar("double")(_net)
    return lineitem.select("l_orderkey", "l_linenumber", net("l_extendedprice", "l_discount").alias("net"))


def _net(price: pd.Series, discount: pd.Series) -> pd.Series:
    return price * (1 - discount)


@over("ext_udaf", ["events"], "select event_type, count(value) as n, min(value) as least, max(value) as most, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by 1")
def _(events: DataFrame) -> DataFrame:
    """A user's aggregate, a state for each key of each batch."""
    merge = [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("cents").alias("cents")]
    return vectorised.aggregate(events.select("event_type", "value"), ["event_type"], _spread, "event_type string, n long, least double, most double, cents long", merge)


def _spread(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.assign(cents=(rows.value * 100).round().fillna(0).astype("int64"))
    return rows.groupby("event_type", dropna=False, as_index=False).agg(n=("value", "count"), least=("value", "min"), most=("value", "max"), cents=("cents", "sum"))


@over("ext_udtf", ["part"], "select p_partkey, cast(k as integer) as place, w as word from (select p_partkey, unnest(string_split(p_name, ' ')) as w, generate_subscripts(string_split(p_name, ' '), 1) as k from part)")
def _(part: DataFrame) -> DataFrame:
    words = vectorised.table("place int, word string")(_Words)
    return part.lateralJoin(words(F.col("p_name").outer())).select("p_partkey", "place", "word")


class _Words:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(text.split(" "), 1)
