import datetime as dt
import math
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowsmith import ListOf, Not, Record, Scalar, Struct, col, field, open_reader, read, read_bytes
from rowsmith import And, MapOf, Or
from rowsmith.plans.inspect import has_shuffle, num_leaves, pushed_filters, scan_schema, scanned_rows
from rowsmith.session import with_knobs
from rowsmith.sources.parquet import footer
from rowsmith.sources.ranged import read_ranged
from rowsmith.streaming.micro import read_stream

ROWS = 2000


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    n = range(ROWS)
    table = pa.table({
        "id": pa.array(n, pa.int64()),
        "grp": pa.array([i // 100 for i in n], pa.int32()),
        "maybe": pa.array([None if i % 3 == 0 else i % 5 for i in n], pa.int64()),
        "f": pa.array([math.nan if i % 7 == 0 else i / 2 for i in n], pa.float32()),
        "u": pa.array(n, pa.uint64()),
        "ns": pa.array([1000 * i - 500 for i in n], pa.timestamp("ns")),
        "tags": pa.array([None if i % 4 == 0 else ["a", None] for i in n], pa.list_(pa.string())),
        "s": pa.array([{"a": i, "b": "x"} for i in n], pa.struct([("a", pa.int64()), ("b", pa.string())])),
    })
    out = f"{tmp_path_factory.mktemp('data')}/t.parquet"
    pq.write_table(table, out, row_group_size=100)
    return out


def ids(df):
    return sorted(r.id for r in df.collect())


ID = Record(field("id", "int64"))


def test_skips_row_groups(spark, path):
    df = read(spark, path, ID, col("grp").equal(7))
    assert ids(df) == list(range(700, 800))
    assert "EqualTo(grp,7)" in pushed_filters(df)[0]
    assert scan_schema(df) == ["struct<id:bigint,grp:int>"]
    assert scanned_rows(read(spark, path, ID, col("grp").equal(7))) == 100


def test_nulls_and_nan(spark, path):
    assert ids(read(spark, path, ID, Not(col("maybe").not_equal(2)))) == [i for i in range(ROWS) if i % 3 and i % 5 == 2]
    rec = Record(field("id", "int64"), field("maybe", "int64"))
    assert all(r.maybe != 0 or r.id % 3 == 0 or r.id % 5 == 0 for r in read(spark, path, rec).collect())
    assert ids(read(spark, path, ID, Not(col("f").less_or_equal(900)))) == [i for i in range(1801, ROWS) if i % 7]
    assert ids(read(spark, path, ID, col("u").between(3, 5))) == [3, 4, 5]
    assert ids(read(spark, path, ID, col("s", "a").isin(4, 9))) == [4, 9]
    assert ids(read(spark, path, ID, col("tags").equal("a")))[:3] == [1, 2, 3]


def test_errors_name_the_column(spark, path):
    for where in (col("grp").equal("7"), col("f").equal(math.nan), col("id").equal(True)):
        with pytest.raises((TypeError, ValueError), match="grp|f|id"):
            read(spark, path, ID, where)
    with pytest.raises(ValueError, match="gone"):
        read(spark, path, ID, col("gone").equal(1))
    with pytest.raises(TypeError, match="id"):
        read(spark, path, Record(field("id", "string")))


def test_nested_and_nanos(spark, path):
    rec = Record(field("ns", "timestamp_ntz"), field("tags", ListOf(Scalar("string"))), field("s", Struct(field("b", "string"), field("new", "int64"))))
    df = read(spark, path, rec)
    assert "a:bigint" not in scan_schema(df)[0]
    rows = df.collect()
    assert rows[0].ns == dt.datetime(1969, 12, 31, 23, 59, 59, 999999) and rows[1].ns == dt.datetime(1970, 1, 1)
    assert rows[0].tags == [] and rows[1].tags == ["a"] and rows[1].s == ("x", 0)


def test_bytes_ranges_and_streams(spark, path, tmp_path):
    data = open(path, "rb").read()
    where = col("grp").greater_or_equal(18)
    assert ids(read_bytes(spark, data, ID, where)) == list(range(1800, ROWS))
    assert sorted(r.id for r in read_ranged(spark, lambda at, n: data[at : at + n], len(data), ["id", "grp"]).filter("grp >= 18").collect()) == list(range(1800, ROWS))
    folder = path.rsplit("/", 1)[0]
    q = read_stream(spark, folder, ID, where).writeStream.format("memory").queryName("micro").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert spark.table("micro").count() == 200


def test_reader(spark, path):
    df = read(spark, path, ID, ordered=True)
    with open_reader(df) as r:
        assert r.num_rows() == ROWS
        assert [x.id for x in r.read(10)] == list(range(10))
        assert [len(b) for b in r.batches(500)] == [500, 500, 500, 490]
    assert sum(len(b) for b in open_reader(df, prefetch=True).channel(300)) == ROWS
    reader = open_reader(df)
    for batch in reader.channel(100):
        break
    reader.close()
    with pytest.raises(ValueError):
        reader.read(1)


@pytest.fixture(scope="module")
def evolving(tmp_path_factory):
    """Three files with different columns, in a folder; names against the order of the ids."""
    folder = tmp_path_factory.mktemp("evolving")
    pq.write_table(pa.table({"id": pa.array(range(100), pa.int64())}), f"{folder}/c.parquet")
    pq.write_table(pa.table({"id": pa.array(range(100, 200), pa.int64()), "x": pa.array(range(100), pa.int64())}), f"{folder}/a.parquet")
    pq.write_table(pa.table({"s": ["y"] * 50, "id": pa.array(range(200, 250), pa.int64()), "x": pa.array(range(50), pa.int64())}), f"{folder}/b.parquet")
    return str(folder)


@pytest.mark.parametrize("order", ["", "abc", "cab", "bca"])
def test_files_with_different_columns(spark, evolving, order):
    path = [f"{evolving}/{x}.parquet" for x in order] or evolving
    rec = Record(field("id", "int64"), field("x", "int64"), field("s", "string"))
    rows = {r.id: (r.x, r.s) for r in read(spark, path, rec).collect()}
    assert rows == {**{i: (0, "") for i in range(100)}, **{100 + i: (i, "") for i in range(100)}, **{200 + i: (i, "y") for i in range(50)}}
    assert ids(read(spark, path, ID, col("x").greater(40))) == [*range(141, 200), *range(241, 250)]
    assert ids(read(spark, path, ID, Not(col("s").equal("z")))) == [*range(200, 250)]
    df = read(spark, path, ID, ordered=True)
    assert not has_shuffle(df)
    files = {"a": range(100, 200), "b": range(200, 250), "c": range(100)}
    assert [r.id for r in df.collect()] == [i for x in order or "abc" for i in files[x]]


def test_files_with_different_types(spark, tmp_path):
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int32()), "x": [1.5, 2.5]}), f"{tmp_path}/a.parquet")
    pq.write_table(pa.table({"id": pa.array([3], pa.int64())}), f"{tmp_path}/b.parquet")
    rec = Record(field("id", "int64"), field("x", "float64"))
    assert [tuple(r) for r in read(spark, str(tmp_path), rec).collect()] == [(1, 1.5), (2, 2.5), (3, 0.0)]
    assert ids(read(spark, str(tmp_path), rec, col("x").greater(2))) == [2]


def test_order_over_splits_needs_no_sort(spark, path):
    own = spark.newSession()
    for k, v in {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "0"}.items():
        own.conf.set(k, v)
    df = read(own, path, ID, col("id").greater_or_equal(5), ordered=True)
    assert df.rdd.getNumPartitions() > 3 and not has_shuffle(df)
    assert [r.id for r in df.collect()] == list(range(5, ROWS))
    with open_reader(df) as r:
        assert [x.id for b in r.batches(64) for x in b] == list(range(5, ROWS))


def test_knobs(spark, path):
    df = read(spark, path, ID, concurrency=1, batch_rows=7)
    assert df.rdd.getNumPartitions() == 1 and ids(df) == list(range(ROWS))
    assert with_knobs(spark, batch_rows=0).conf.get("spark.sql.parquet.columnarReaderBatchSize") == "1"
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") != "1"
    assert with_knobs(spark, concurrency=0) is spark


def test_footer(spark, tmp_path):
    table = pa.table({"id": pa.array(range(50), pa.int64())}).replace_schema_metadata({"made": "here"})
    pq.write_table(table, f"{tmp_path}/t.parquet", row_group_size=20)
    found = footer(spark, f"{tmp_path}/t.parquet")
    assert (found.rows, found.row_groups, found.metadata["made"]) == (50, [20, 20, 10], "here")
    assert "int64 id" in found.schema and "arrow" in found.created_by


def test_skips_pages(spark, tmp_path):
    """One row group whose pages differ: only the pages that can match are decoded."""
    n = 40_000
    table = pa.table({"id": pa.array(range(n), pa.int64()), "grp": pa.array([i // 400 for i in range(n)], pa.int32())})
    for name, index in (("with", True), ("without", False)):
        pq.write_table(table, f"{tmp_path}/{name}.parquet", row_group_size=n, data_page_size=1024, write_batch_size=256, use_dictionary=False, write_page_index=index)
        df = read(spark, f"{tmp_path}/{name}.parquet", ID, col("grp").between(50, 51))
        assert ids(df) == list(range(20_000, 20_800))
        rows = scanned_rows(read(spark, f"{tmp_path}/{name}.parquet", ID, col("grp").between(50, 51)))
        assert rows < 2000 if index else rows == n


def test_skips_by_bloom_filter(spark, tmp_path):
    out = f"{tmp_path}/bloom"
    spark.range(0, 20_000).selectExpr("id", "cast(pmod(xxhash64(id), 1000000) * 2 AS bigint) AS key").coalesce(1).write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", "20000").option("parquet.enable.dictionary", "false").parquet(out)
    assert scanned_rows(read(spark, out, ID, col("key").equal(1_000_001))) == 0
    some = spark.read.parquet(out).first()
    assert some.id in ids(read(spark, out, ID, col("key").equal(some.key)))


def test_filtered_streams(spark, path):
    where = [Or(col("grp").equal(3), col("grp").greater(17)), col("maybe").not_equal(1)]
    want = [i for i in range(ROWS) if (i // 100 == 3 or i // 100 > 17) and i % 3 and i % 5 != 1]
    df = read(spark, path, ID, where, ordered=True)
    with open_reader(df) as r:
        assert [x.id for x in r.read(5)] == want[:5]
        assert [x.id for b in r.batches(33) for x in b] == want[5:]
        assert r.read(1) == []
    assert [x.id for b in open_reader(df, prefetch=True).channel(50) for x in b] == want
    assert open_reader(read(spark, path, ID, col("grp").equal(99))).read(3) == []


def test_ranged_records(spark, path):
    data = open(path, "rb").read()
    asked = spark.sparkContext.accumulator(0)

    def read_at(at, n):
        asked.add(n)
        return data[at : at + n]

    rec = Record(field("id", "int64"), field("maybe", "int64"), field("s", Struct(field("a", "int64"))), field("gone", "string"), field("tags", ListOf(Scalar("string"))))
    df = read_ranged(spark, read_at, len(data), rec, [col("grp").isin(3, 7), Not(col("maybe").equal(2))])
    got = {r.id: r for r in df.collect()}
    assert sorted(got) == [i for i in range(ROWS) if i // 100 in (3, 7) and i % 3 and i % 5 != 2]
    assert got[301].s.a == 301 and got[301].gone == "" and got[301].tags == ["a"] and got[301].maybe == 1
    assert asked.value < len(data)
    assert sorted(r.id for r in read_ranged(spark, lambda at, n: data[at : at + n], len(data), Record(field("id", "int64"), field("ns", "timestamp_ntz")), col("id").less(3)).collect()) == [0, 1, 2]


def test_maps_of_times_and_old_lists(spark, tmp_path):
    at = dt.datetime(1999, 1, 2, 3, 4, 5, 6)
    table = pa.table({
        "id": pa.array([1, 2], pa.int64()),
        "m": pa.array([[("a", at), ("b", None)], None], pa.map_(pa.string(), pa.timestamp("us"))),
        "n": pa.array([[("a", 1_000_000_500)], []], pa.map_(pa.string(), pa.int64())),
        "l": pa.array([[1, None], None], pa.list_(pa.int64())),
    })
    pq.write_table(table, f"{tmp_path}/three.parquet")
    pq.write_table(table, f"{tmp_path}/other.parquet", use_compliant_nested_type=False)
    rec = Record(field("id", "int64"), field("m", MapOf(Scalar("string"), Scalar("timestamp_ntz"))), field("n", MapOf(Scalar("string"), Scalar("timestamp_ntz"))), field("l", ListOf(Scalar("int64"))))
    for name in ("three", "other"):
        one, two = read(spark, f"{tmp_path}/{name}.parquet", rec, ordered=True).collect()
        assert one.m == {"a": at, "b": dt.datetime(1, 1, 1)} and two.m == {}
        assert one.n == {"a": dt.datetime(1970, 1, 1, 0, 0, 1)} and one.l == [1] and two.l == []
    # two levels: a repeated field without a group around it
    spark.conf.set("spark.sql.parquet.writeLegacyFormat", "true")
    try:
        spark.sql("SELECT 1L AS id, array(1L, 2L) AS l, array(named_struct('a', 1L)) AS ls").write.parquet(f"{tmp_path}/old")
    finally:
        spark.conf.unset("spark.sql.parquet.writeLegacyFormat")
    assert "array" in footer(spark, spark.read.parquet(f"{tmp_path}/old").inputFiles()[0]).schema
    old = read(spark, f"{tmp_path}/old", Record(field("l", ListOf(Scalar("int64"))), field("ls", ListOf(Struct(field("a", "int64")))))).collect()
    assert old[0].l == [1, 2] and old[0].ls[0].a == 1


def test_leaves(spark, path):
    assert num_leaves(read(spark, path, ID)) == 1
    assert num_leaves(read(spark, path, Record(field("s", Struct(field("a", "int64"))), field("tags", ListOf(Scalar("string")))), col("grp").equal(1))) == 3


LITERALS = [
    ("i8", 1), ("i16", 1), ("i32", 1), ("i64", 1), ("u8", 1), ("u16", 1), ("u32", 1), ("u64", 1), ("f32", 1.0), ("f32", 1), ("f64", 1.0), ("f64", 1),
    ("b", True), ("s", "1"), ("s", b"1"), ("raw", b"1"), ("raw", "1"), ("d", dt.date(1970, 1, 2)), ("t", dt.datetime(1970, 1, 2)), ("t", dt.datetime(1970, 1, 2, tzinfo=dt.UTC)), ("dec", Decimal(1)), ("dec", 1),
]
WRONG = [("i32", "1"), ("i32", 1.0), ("i32", True), ("f64", "1"), ("b", 1), ("s", 1), ("raw", 1), ("d", 1), ("t", 1), ("t", "1970-01-02"), ("dec", "1")]


@pytest.fixture(scope="module")
def kinds(tmp_path_factory):
    ints = {"i8": pa.int8(), "i16": pa.int16(), "i32": pa.int32(), "i64": pa.int64(), "u8": pa.uint8(), "u16": pa.uint16(), "u32": pa.uint32(), "u64": pa.uint64()}
    table = pa.table({
        "id": pa.array([1, 2], pa.int64()), **{k: pa.array([1, 2], t) for k, t in ints.items()}, "f32": pa.array([1, 2], pa.float32()), "f64": [1.0, 2.0], "b": [True, False], "s": ["1", "2"], "raw": [b"1", b"2"],
        "d": pa.array([1, 2], pa.date32()), "t": pa.array([86400 * 10**6, 0], pa.timestamp("us")), "dec": pa.array([Decimal(1), Decimal(2)], pa.decimal128(9, 2)),
    })
    out = f"{tmp_path_factory.mktemp('kinds')}/t.parquet"
    pq.write_table(table, out)
    return out


@pytest.mark.parametrize(("name", "value"), LITERALS)
def test_literal(spark, kinds, name, value):
    assert ids(read(spark, kinds, ID, col(name).equal(value))) == [1]
    assert ids(read(spark, kinds, ID, And(col(name).not_equal(value), ~col(name).isin(value)))) == [2]


@pytest.mark.parametrize(("name", "value"), WRONG)
def test_wrong_literal(spark, kinds, name, value):
    with pytest.raises(TypeError, match=name):
        read(spark, kinds, ID, col(name).equal(value))


def test_options_reach_the_reader(spark, evolving):
    df = read(spark, evolving, ID, options={"pathGlobFilter": "b*.parquet"})
    assert ids(df) == list(range(200, 250))


def test_stream_over_files_with_different_columns(spark, evolving, tmp_path):
    rec = Record(field("id", "int64"), field("x", "int64"), field("s", "string"))
    q = read_stream(spark, evolving, rec, col("id").less(220), max_files=1).writeStream.format("memory").queryName("evolving").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    got = {r.id: (r.x, r.s) for r in spark.table("evolving").collect()}
    assert got == {**{i: (0, "") for i in range(100)}, **{100 + i: (i, "") for i in range(100)}, **{200 + i: (i, "y") for i in range(20)}}
