"""The query catalogue: one query per reader operation, with the SQL that gives the same rows.

Queries over nested or evolving files write those files to the scratch folder once in an application, from the
driver's tables, and read them from there.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions.fields import ListOf, MapOf, Record, Scalar, Struct, field, nanos_to_timestamp
from rowsmith.operators.predicates import And, Not, Or, Predicate, col
from rowsmith.operators.relation import bind_frame
from rowsmith.session import configure, scratch_dir
from rowsmith.sources.parquet import footer, locate_rows, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KINDS = {
    "lineitem": {"l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int32", "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "orders": {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "string", "o_totalprice": "float64", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "customer": {"c_custkey": "int64", "c_name": "string", "c_nationkey": "int32", "c_acctbal": "float64", "c_mktsegment": "string"},
    "events": {"event_id": "int64", "ts": "timestamp_ntz", "user_id": "int64", "event_type": "string", "value": "float64", "props": "string"},
    "region": {"r_regionkey": "int32", "r_name": "string"},
    "embeddings": {"vec_id": "int64", "label": "int32"},
}


def record(table: str, names: str = "") -> Record:
    kinds = KINDS[table]
    return Record(*[field(n, kinds[n]) for n in (names.split() or kinds)])


def simple(name: str, table: str, names: str, where: Predicate | list[Predicate] | None, sql: str) -> None:
    """A scan-filter-project query; `sql` is its WHERE clause."""
    QUERIES[name] = lambda spark, d: read(spark, f"{d}/{table}.parquet", record(table, names), where)
    SQL[name] = f"SELECT {', '.join(names.split()) or '*'} FROM {table}" + (f" WHERE {sql}" if sql else "")


def query(name: str, sql: str | None):
    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: f(configure(spark), d)
        if sql:
            SQL[name] = sql
        return f

    return put


_written: dict[tuple[str, ...], str] = {}


def written(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame | dict[str, DataFrame]]) -> str:
    """The folder of files made from the tables in `d`: one table, or several files by name."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _written:
        folder = f"{scratch_dir(spark)}/{key[0]}/{name}-{uuid.uuid4().hex}"
        made = make()
        for part, df in made.items() if isinstance(made, dict) else [("", made)]:
            df.write.parquet(f"{folder}/{part}".rstrip("/"))
        _written[key] = folder
    return _written[key]


def nested(spark: SparkSession, d: str, name: str, table: str, *columns: str) -> str:
    """A file of one table's SQL expressions."""
    return written(spark, d, name, lambda: spark.read.parquet(f"{d}/{table}.parquet").selectExpr(*columns))


simple("full_scan", "orders", "", None, "")
simple("full_lineitem", "lineitem", "", None, "")
simple("project_1", "lineitem", "l_quantity", None, "")
simple("project_3", "lineitem", "l_orderkey l_quantity l_shipdate", None, "")
simple("project_5", "lineitem", "l_orderkey l_partkey l_quantity l_extendedprice l_returnflag", None, "")
simple("project_10", "lineitem", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus", None, "")
simple("project_drop_list", "embeddings", "vec_id label", None, "")
simple("eq_int", "orders", "o_orderkey o_custkey", col("o_custkey").equal(7), "o_custkey = 7")
simple("eq_str", "customer", "c_custkey c_name", col("c_mktsegment").equal("BUILDING"), "c_mktsegment = 'BUILDING'")
simple("eq_float", "lineitem", "l_orderkey l_quantity", col("l_quantity").equal(17), "l_quantity = 17")
simple("ne_str", "events", "event_id event_type", col("event_type").not_equal("view"), "event_type <> 'view'")
simple("lt", "lineitem", "l_orderkey l_quantity", col("l_quantity").less(10.0), "l_quantity < 10")
simple("le", "lineitem", "l_orderkey l_quantity", col("l_quantity").less_or_equal(10.0), "l_quantity <= 10")
simple("gt", "lineitem", "l_orderkey l_quantity", col("l_quantity").greater(40.0), "l_quantity > 40")
simple("ge", "lineitem", "l_orderkey l_quantity", col("l_quantity").greater_or_equal(40.0), "l_quantity >= 40")
simple("between_int", "lineitem", "l_orderkey l_linenumber", col("l_linenumber").between(2, 4), "l_linenumber BETWEEN 2 AND 4")
simple("between_time", "lineitem", "l_orderkey l_shipdate", col("l_shipdate").between(dt.datetime(1994, 1, 1), dt.datetime(1995, 6, 30)), "l_shipdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-06-30'")
simple("in_str", "events", "event_id event_type", col("event_type").isin("click", "purchase"), "event_type IN ('click', 'purchase')")
simple("in_int", "orders", "o_orderkey o_custkey", col("o_custkey").isin(*range(1, 20)), f"o_custkey IN ({', '.join(map(str, range(1, 20)))})")
simple("in_empty", "orders", "o_orderkey", col("o_custkey").isin(), "false")
simple("not_in", "events", "event_id event_type", Not(col("event_type").isin("click", "view")), "event_type NOT IN ('click', 'view')")
simple("and_multi", "orders", "o_orderkey o_totalprice", And(col("o_totalprice").greater(1000), col("o_orderstatus").equal("F"), col("o_custkey").less(500)), "o_totalprice > 1000 AND o_orderstatus = 'F' AND o_custkey < 500")
simple("not_and", "orders", "o_orderkey", Not(And(col("o_totalprice").greater(1000), col("o_orderstatus").equal("F"))), "NOT (o_totalprice > 1000 AND o_orderstatus = 'F')")
simple("or_cross", "orders", "o_orderkey o_totalprice", Or(col("o_totalprice").greater(400000), col("o_orderstatus").equal("P")), "o_totalprice > 400000 OR o_orderstatus = 'P'")
simple("nested_and_or", "orders", "o_orderkey", And(Or(col("o_orderstatus").equal("F"), col("o_orderstatus").equal("O")), Not(And(col("o_custkey").less(100), col("o_totalprice").less(200000)))), "(o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT (o_custkey < 100 AND o_totalprice < 200000)")
simple("not_leaf", "lineitem", "l_orderkey l_quantity", Not(col("l_quantity").less(25)), "NOT (l_quantity < 25)")
simple("not_between", "lineitem", "l_orderkey l_quantity", Not(col("l_quantity").between(5, 45)), "l_quantity NOT BETWEEN 5 AND 45")
simple("not_not", "lineitem", "l_orderkey l_quantity", Not(Not(col("l_quantity").less(5))), "l_quantity < 5")
simple("not_or", "lineitem", "l_orderkey", Not(Or(col("l_quantity").less(25), col("l_returnflag").equal("N"))), "NOT (l_quantity < 25 OR l_returnflag = 'N')")
simple("where_multi", "lineitem", "l_orderkey l_discount", [col("l_quantity").less(24), col("l_discount").between(0.05, 0.07)], "l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07")
simple("and_empty", "region", "", And(), "")
simple("or_empty", "region", "", Or(), "false")
simple("filter_unprojected", "events", "event_id", col("event_type").equal("click"), "event_type = 'click'")
simple("flagship", "lineitem", "l_orderkey l_quantity l_shipdate", [col("l_quantity").between(10, 20), col("l_shipdate").greater_or_equal(dt.datetime(1995, 1, 1))], "l_quantity BETWEEN 10 AND 20 AND l_shipdate >= TIMESTAMP '1995-01-01'")


@query("project_nested_list", "SELECT vec_id, embedding FROM embeddings")
def project_nested_list(spark, d):
    return read(spark, f"{d}/embeddings.parquet", Record(field("vec_id", "int64"), field("embedding", ListOf(Scalar("float32")))))


@query("nullable_list_elements", "SELECT vec_id, embedding FROM embeddings WHERE label >= 2")
def nullable_list_elements(spark, d):
    rec = Record(field("vec_id", "int64"), field("embedding", ListOf(Scalar("float32", nullable=True))))
    return read(spark, f"{d}/embeddings.parquet", rec, col("label").greater_or_equal(2))


@query("filter_first_elem", "SELECT vec_id FROM embeddings WHERE embedding[1] > 0")
def filter_first_elem(spark, d):
    return read(spark, f"{d}/embeddings.parquet", Record(field("vec_id", "int64")), col("embedding").greater(0))


@query("float_literal", "SELECT vec_id FROM embeddings WHERE embedding[1] > 0.1::FLOAT")
def float_literal(spark, d):
    return read(spark, f"{d}/embeddings.parquet", Record(field("vec_id", "int64")), col("embedding").greater(0.1))


@query("evolve_missing", "SELECT n_name, 0::BIGINT AS extra, '' AS note, NULL::INTEGER AS maybe FROM nation")
def evolve_missing(spark, d):
    rec = Record(field("n_name", "string"), field("extra", "int64"), field("note", "string"), field("maybe", "int32", nullable=True))
    return read(spark, f"{d}/nation.parquet", rec)


def with_nulls(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr("nullif(o_custkey % 5, 0)").alias("k"), F.expr("nullif(o_orderstatus, 'F')").alias("s"))


_NULLS = "(SELECT o_orderkey, nullif(o_custkey % 5, 0) AS k, nullif(o_orderstatus, 'F') AS s FROM orders)"


@query("zero_null", f"SELECT o_orderkey, coalesce(k, 0) AS k, coalesce(s, '') AS s FROM {_NULLS}")
def zero_null(spark, d):
    return bind_frame(with_nulls(spark, d), Record(field("o_orderkey", "int64"), field("k", "int64"), field("s", "string")))


@query("native_null", f"SELECT o_orderkey, k, coalesce(s, '') AS s FROM {_NULLS}")
def native_null(spark, d):
    return bind_frame(with_nulls(spark, d), Record(field("o_orderkey", "int64"), field("k", "int64", nullable=True), field("s", "string")))


@query("null_never_matches", f"SELECT o_orderkey, coalesce(k, 0) AS k FROM {_NULLS} WHERE NOT (k < 3)")
def null_never_matches(spark, d):
    return bind_frame(with_nulls(spark, d), Record(field("o_orderkey", "int64"), field("k", "int64")), Not(col("k").less(3)))


@query("nan_guard", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM events) WHERE value > 50 AND NOT isnan(value)")
def nan_guard(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("CASE WHEN event_id % 7 = 0 THEN double('NaN') ELSE value END").alias("value"))
    return bind_frame(df, Record(field("event_id", "int64")), Not(col("value").less_or_equal(50)))


@query("evolve_files", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus ELSE '' END AS o_orderstatus FROM orders")
def evolve_files(spark, d):
    return read(spark, evolving(spark, d), Record(field("o_orderkey", "int64"), field("o_custkey", "int64"), field("o_totalprice", "float64", nullable=True), field("o_orderstatus", "string")))


@query("evolve_files_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice > 200000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey < 10")
def evolve_files_filter(spark, d):
    # a file that lacks a column has no match on it
    where = Or(col("o_totalprice").greater(200000), And(col("o_custkey").less(10), Not(col("o_totalprice").between(-1e18, 1e18)), col("kind").equal(0)), And(col("o_custkey").less(10), col("kind").equal(0)))
    return read(spark, evolving(spark, d), Record(field("o_orderkey", "int64")), where)


def evolving(spark: SparkSession, d: str) -> list[str]:
    """Three files with different columns."""

    def make() -> dict[str, DataFrame]:
        df = spark.read.parquet(f"{d}/orders.parquet")
        part = lambda i: df.filter(f"o_orderkey % 3 = {i}")
        return {
            "a": part(0).selectExpr("o_orderkey", "o_custkey", "0 AS kind"),
            "b": part(1).select("o_totalprice", "o_orderkey"),
            "c": part(2).selectExpr("o_orderstatus", "o_orderkey", "o_totalprice", "o_custkey", "2 AS kind"),
        }

    folder = written(spark, d, "evolving", make)
    return [f"{folder}/{x}" for x in "abc"]


@query("struct_bind", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), '') AS st, o_totalprice AS price, o_custkey % 3 = 0 AS absent FROM orders")
def struct_bind(spark, d):
    path = nested(spark, d, "structs", "orders", "o_orderkey", "named_struct('st', nullif(o_orderstatus, 'F'), 'price', o_totalprice, 'unread', o_custkey) AS inner", "if(o_custkey % 3 = 0, null, named_struct('c', o_custkey)) AS maybe")
    rec = Record(field("o_orderkey", "int64"), field("inner", Struct(field("st", "string"), field("price", "float64"))), field("maybe", Struct(field("c", "int64"), nullable=True)))
    return read(spark, path, rec).select("o_orderkey", "inner.st", "inner.price", F.col("maybe").isNull().alias("absent"))


def order_lines(spark: SparkSession, d: str) -> str:
    """One row for each order, with its lines as a list of structs and their flags as a list with nulls."""
    lines = "collect_list(named_struct('part', l_partkey, 'flag', nullif(l_returnflag, 'N'), 'unread', l_tax)) AS items"

    def make() -> DataFrame:
        df = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.expr(lines))
        return df.selectExpr("l_orderkey", "items", "transform(items, x -> x.flag) AS flags")

    return written(spark, d, "order_lines", make)


@query("struct_list", "SELECT l_orderkey, l_partkey AS part, coalesce(nullif(l_returnflag, 'N'), '') AS flag FROM lineitem")
def struct_list(spark, d):
    rec = Record(field("l_orderkey", "int64"), field("items", ListOf(Struct(field("part", "int64"), field("flag", "string")))))
    return read(spark, order_lines(spark, d), rec).selectExpr("l_orderkey", "inline(items) AS (part, flag)")


@query("list_compact", "SELECT l_orderkey, count(nullif(l_returnflag, 'N'))::INTEGER AS n FROM lineitem GROUP BY l_orderkey")
def list_compact(spark, d):
    return read(spark, order_lines(spark, d), Record(field("l_orderkey", "int64"), field("flags", ListOf(Scalar("string"))))).select("l_orderkey", F.size("flags").alias("n"))


def customer_maps(spark: SparkSession, d: str) -> str:
    return nested(spark, d, "maps", "customer", "c_custkey", "map('nation', nullif(c_nationkey, 3), 'fixed', 1) AS m", "map(c_mktsegment, map('bal', c_acctbal)) AS mm", "map(c_mktsegment, named_struct('nation', c_nationkey, 'unread', c_name)) AS ms")


@query("map_zero", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), 0)::INTEGER AS nation, 1 AS fixed FROM customer")
def map_zero(spark, d):
    out = read(spark, customer_maps(spark, d), Record(field("c_custkey", "int64"), field("m", MapOf(Scalar("string"), Scalar("int32")))))
    return out.select("c_custkey", F.col("m")["nation"].alias("nation"), F.col("m")["fixed"].alias("fixed"))


@query("nested_map", "SELECT c_custkey, c_acctbal AS bal FROM customer")
def nested_map(spark, d):
    out = read(spark, customer_maps(spark, d), Record(field("c_custkey", "int64"), field("mm", MapOf(Scalar("string"), MapOf(Scalar("string"), Scalar("float64"))))))
    return out.select("c_custkey", F.explode("mm").alias("k", "v")).select("c_custkey", F.col("v")["bal"].alias("bal"))


@query("map_struct", "SELECT c_custkey, c_mktsegment AS k, c_nationkey AS nation, 0::BIGINT AS gone FROM customer")
def map_struct(spark, d):
    rec = Record(field("c_custkey", "int64"), field("ms", MapOf(Scalar("string"), Struct(field("nation", "int32"), field("gone", "int64")))))
    return read(spark, customer_maps(spark, d), rec).select("c_custkey", F.explode("ms").alias("k", "v")).select("c_custkey", "k", "v.nation", "v.gone")


def order_times(spark: SparkSession, d: str) -> str:
    return nested(spark, d, "times", "orders", "o_orderkey", "array(o_orderdate, null) AS ts", "map('at', o_orderdate, 'never', null) AS tm", "unix_date(date(o_orderdate)) AS d")


@query("time_list", "SELECT o_orderkey, o_orderdate AS t FROM orders")
def time_list(spark, d):
    out = read(spark, order_times(spark, d), Record(field("o_orderkey", "int64"), field("ts", ListOf(Scalar("timestamp_ntz")))))
    return out.select("o_orderkey", F.explode("ts").alias("t"))


@query("time_map", "SELECT o_orderkey, o_orderdate AS at, TIMESTAMP '0001-01-01 00:00:00' AS never FROM orders")
def time_map(spark, d):
    out = read(spark, order_times(spark, d), Record(field("o_orderkey", "int64"), field("tm", MapOf(Scalar("string"), Scalar("timestamp_ntz")))))
    return out.select("o_orderkey", F.col("tm")["at"].alias("at"), F.col("tm")["never"].alias("never"))


@query("date_bind", "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderdate::DATE < DATE '1995-03-01'")
def date_bind(spark, d):
    return read(spark, order_times(spark, d), Record(field("o_orderkey", "int64"), field("d", "date"))).filter(F.col("d") < F.lit(dt.date(1995, 3, 1)))


@query("time_nanos", "SELECT event_id, epoch_us(ts) - 1800000000000000 AS us FROM events")
def time_nanos(spark, d):
    # shifted before 1970, with a fraction below the microsecond
    path = nested(spark, d, "nanos", "events", "event_id", "(unix_micros(cast(ts AS timestamp)) - 1800000000000000) * 1000 + event_id % 1000 AS n")
    return read(spark, path, Record(field("event_id", "int64"), field("n", "timestamp"))).select("event_id", F.unix_micros("n").alias("us"))


@query("decimal_unscaled", "SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem")
def decimal_unscaled(spark, d):
    path = nested(spark, d, "cents", "lineitem", "l_orderkey", "l_linenumber", "cast(round(l_extendedprice * 100) / 100 AS decimal(18,2)) AS cents")
    return read(spark, path, Record(field("l_orderkey", "int64"), field("l_linenumber", "int32"), field("cents", Scalar("int64", unscaled=True))))


@query("uint64_literal", "SELECT o_orderkey, o_custkey::DECIMAL(20,0) AS u FROM orders WHERE o_custkey > 100")
def uint64_literal(spark, d):
    path = nested(spark, d, "unsigned", "orders", "o_orderkey", "cast(o_custkey AS decimal(20,0)) AS u")
    return read(spark, path, Record(field("o_orderkey", "int64"), field("u", "uint64")), col("u").greater(100))


@query("ordered_rows", "SELECT l_orderkey, l_linenumber, row_number() OVER () - 1 AS row_index FROM lineitem")
def ordered_rows(spark, d):
    return locate_rows(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber"])


@query("ordered_read", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def ordered_read(spark, d):
    return read(spark, f"{d}/lineitem.parquet", record("lineitem", "l_orderkey l_quantity"), col("l_quantity").greater(45), ordered=True)


@query("ordered_files", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderkey % 3 <> 0")
def ordered_files(spark, d):
    return read(spark, evolving(spark, d), Record(field("o_orderkey", "int64")), col("o_totalprice").greater(200000), ordered=True)


@query("no_projection", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_tax < 0.02")
def no_projection(spark, d):
    return read(spark, f"{d}/lineitem.parquet", record("lineitem", "l_orderkey l_quantity"), col("l_tax").less(0.02), project=False)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("row_count", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def row_count(spark, d):
    out = None
    for t in _TABLES:
        one = spark.read.parquet(f"{d}/{t}.parquet").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("consumer_agg", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS lines, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_quantity > 20")
def consumer_agg(spark, d):
    df = read(spark, f"{d}/lineitem.parquet", record("lineitem", "l_linenumber l_quantity"), col("l_quantity").greater(20))
    return df.agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("footers", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, true AS spark FROM {t}" for t in ("orders", "customer")))
def footers(spark, d):
    """Rows and writer's metadata from the footers of files with several row groups."""
    found = []
    for t in ("orders", "customer"):
        path = written(spark, d, f"copy-{t}", lambda t=t: spark.read.parquet(f"{d}/{t}.parquet"))
        own = [footer(spark, f) for f in spark.read.parquet(path).inputFiles()]
        found.append((t, sum(f.rows for f in own), all("org.apache.spark.sql.parquet.row.metadata" in f.metadata and sum(f.row_groups) == f.rows for f in own)))
    return spark.createDataFrame(found, "name string, n bigint, spark boolean")


@query("blob_bytes", "SELECT count(*) AS n, sum(strlen(p_name))::BIGINT AS a, sum(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE strlen(p_type) END)::BIGINT AS b, sum(strlen(p_name) + strlen(p_type))::BIGINT AS parts FROM part")
def blob_bytes(spark, d):
    """The bytes of several blobs and of a list of blobs."""
    path = nested(spark, d, "blobs", "part", "cast(p_name AS binary) AS a", "if(p_partkey % 4 = 0, null, cast(p_type AS binary)) AS b", "array(cast(p_name AS binary), cast(p_type AS binary), null) AS parts")
    df = read(spark, path, Record(field("a", "bytes"), field("b", "bytes"), field("parts", ListOf(Scalar("bytes")))))
    each = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x))
    return df.agg(F.count("*").alias("n"), F.sum(F.octet_length("a")).alias("a"), F.sum(F.octet_length("b")).alias("b"), F.sum(each).alias("parts"))


@query("map_explode_agg", "SELECT count(*) AS n, sum(l_quantity) AS units FROM lineitem")
def map_explode_agg(spark, d):
    path = nested(spark, d, "units", "lineitem", "map('a', l_quantity) AS m")
    df = read(spark, path, Record(field("m", MapOf(Scalar("string"), Scalar("float64")))))
    return df.select(F.explode(F.map_values("m")).alias("u")).agg(F.count("*").alias("n"), F.sum("u").alias("units"))


@query("early_stop", "SELECT least(100, count(*))::BIGINT AS n, true AS ok FROM orders WHERE o_custkey > 10")
def early_stop(spark, d):
    df = read(spark, f"{d}/orders.parquet", record("orders", "o_orderkey o_custkey"), col("o_custkey").greater(10)).limit(100)
    return df.agg(F.count("*").alias("n"), F.min(F.col("o_custkey") > 10).alias("ok"))
