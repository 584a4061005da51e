"""Networks made from the driver's tables, and the SQL of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..net import Net

TRADE = """
    select cast(c_nationkey as bigint) src, cast(s_nationkey as bigint) dst, count(*) weight
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join supplier on l_suppkey = s_suppkey group by c_nationkey, s_nationkey"""
HANDOFF = """
    select user_id src, lead(user_id) over (order by ts, event_id) dst from events
    where event_type = 'purchase'{more}"""


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _kept(net: Net) -> Net:
    """The net with its tables written, so that operators that read them often don't make them again."""
    return net.replace(edges=stored(net.edges, "ties"), vertices=stored(net.vertices, "vertices"))


def _trade_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitems from customers' nations to suppliers'. Lineitems are counted by key before they meet the other tables."""
    line = _table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    supplier = _table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    got = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "dst").agg(F.sum("c").alias("c"))
    got = got.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return got.groupBy("src", "dst").agg(F.sum("c").alias("weight"))


def trade(spark: SparkSession, folder: str, factor: float = 1.0, directed: bool = True, loops: bool = True) -> Net:
    """Nations, tied if more lineitems than ``factor`` times the mean went from one's suppliers to the other's customers."""
    cells = _trade_cells(spark, folder)
    mean = cells.agg((F.avg("weight") * factor).alias("least"))
    ties = cells.join(F.broadcast(mean)).filter("weight > least").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    nations = _table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("vid"), F.col("n_regionkey").cast("long").alias("cl"))
    return _kept(Net.build(ties, nations, directed, loops))


def handoff(spark: SparkSession, folder: str, least: float | None = None) -> Net:
    """Users, tied if one's purchase (above ``least``) was followed by the other's.

    Each purchase finds its successor within its hour; only the first and last of hours meet across hours, so no task gets
    the whole stream.
    """
    from pyspark.sql import Window

    buys = _table(spark, folder, "events").filter("event_type = 'purchase'")
    if least is not None:
        buys = buys.filter(F.col("value") > least)
    buys = buys.select("ts", "event_id", F.col("user_id").cast("long").alias("src"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("hour"))
    order = Window.partitionBy("hour").orderBy("ts", "event_id")
    inner = buys.select("hour", "src", F.lead("src").over(order).alias("dst"))
    first = F.min(F.struct("ts", "event_id", "src"))
    last = F.max(F.struct("ts", "event_id", "src"))
    ends = buys.groupBy("hour").agg(first.alias("f"), last.alias("l"))
    across = ends.select(F.col("l.src").alias("src"), F.lead("f.src").over(Window.orderBy("hour")).alias("dst"))
    ties = inner.select("src", "dst").filter("dst is not null").unionAll(across.filter("dst is not null")).distinct()
    top = _table(spark, folder, "events").agg(F.max("user_id")).first()[0]
    return _kept(Net.build(ties, spark.range(0, (top if top is not None else -1) + 1).select(F.col("id").alias("vid")), True, True))


def supply(spark: SparkSession, folder: str, least: float = 0.0) -> Net:
    """Parts (mode 1) and suppliers, tied by a lineitem of a quantity of at least ``least``. A supplier's vertex is its key after the last part's."""
    parts = _table(spark, folder, "part").select(F.col("p_partkey").cast("long").alias("vid"))
    top = parts.agg(F.max("vid")).first()[0]
    suppliers = _table(spark, folder, "supplier").select((F.col("s_suppkey") + top + 1).cast("long").alias("vid"))
    ties = _table(spark, folder, "lineitem").filter(F.col("l_quantity") >= least).select(F.col("l_partkey").cast("long").alias("src"), (F.col("l_suppkey") + top + 1).cast("long").alias("dst")).distinct()
    return _kept(Net.build(ties, parts.unionAll(suppliers), False, False, top))


def sql(name: str) -> str:
    """CTEs of a network: e (src, dst, weight), v (vid, cl), n (n), a (arcs src, dst, w without loops)."""
    if name.startswith("trade"):
        factor = {"trade": "1.0", "trade125": "1.25"}[name]
        ties = f"w0 as ({TRADE}), e as (select src, dst, cast(weight as double) weight from w0 where weight > (select avg(weight) * {factor} from w0))"
        vertices = "v as (select cast(n_nationkey as bigint) vid, cast(n_regionkey as bigint) cl from nation)"
    else:
        more = {"handoff": "", "handoff100": " and value > 100", "handoff150": " and value > 150"}[name]
        ties = f"q0 as ({HANDOFF.format(more=more)}), e as (select distinct cast(src as bigint) src, cast(dst as bigint) dst, 1.0::double weight from q0 where dst is not null)"
        vertices = "v as (select unnest(range(0, (select max(user_id) + 1 from events))) vid, 0::bigint cl)"
    return f"{ties}, {vertices}, n as (select count(*) n from v), a as (select src, dst, weight w from e where src <> dst)"
