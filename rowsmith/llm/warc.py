"""Operator 5, not-modified revisits: an as-of join to the latest earlier full response.

Records are responses and revisits of a crawl: record_id, url, at (any orderable long), kind, headers (a map
with lower-case names). A revisit resolves to the last response of the same canonical URL strictly before it,
if the validators agree (entity tags, compared weakly, where both have one, else last-modified dates); its
headers are then the response's, with those of the revisit laid over except FIXED ones, which describe the
stored body.

The join is native and in two levels, so that a URL with any share of the records is never one task's work. The
records of a URL with over BLOCK_ROWS of them are cut into blocks at CUTS quantiles of its own times; an instant
that alone fills a block is a block of its own, where nothing is earlier than anything else, so its records are
dealt out by salt. A window over (URL, block) finds earlier responses within a block, and for the rest the last
response of each block (a partial maximum) is carried forward by a window over the few blocks of a URL. Only
keys, times and headers are shuffled, never bodies.

Defined cases: null URLs, times or kinds: such records are neither found nor resolved (a revisit is reported as
`no_response`); among responses at one time the largest record_id wins; repeated rows each get a row; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import write_table

BLOCK_ROWS = 50_000
CUTS = 1000
SALTS = 32
FEW = 500  # URLs whose cuts, of 16 kB at most, are broadcast
#: Header fields that a not-modified answer may not change, since they describe the body.
FIXED = ["content-encoding", "content-length", "content-md5", "content-range", "content-type", "transfer-encoding"]


def canonical(url: Column) -> Column:
    """No scheme, user, `www.`, default port, fragment, tracking parameter or last slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?", "")
    bare = F.regexp_replace(bare, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    args = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    args = F.array_sort(F.filter(args, lambda a: (a != "") & ~a.rlike("^utm_")))
    return F.concat(host, path, F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise(F.lit("")))


def blocks(r: DataFrame) -> DataFrame:
    """The records with block and salt."""
    usable = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    zero = F.lit(0)
    hot = r.filter(usable).groupBy("url_key").count().filter(F.col("count") > BLOCK_ROWS).select("url_key")
    hot = write_table(hot, "revisit-hot")
    n = hot.count()
    if not n:
        return r.withColumns({"block": zero, "salt": zero})
    few = n <= FEW
    shares = [i / CUTS for i in range(1, CUTS)]
    own = r.select("url_key", "at").join(F.broadcast(hot) if few else hot, "url_key", "left_semi")
    cuts = own.groupBy("url_key").agg(F.percentile_approx("at", shares, 10 * CUTS).alias("q"))
    dense = F.array_distinct(F.filter("q", lambda x, i: (i > 0) & (x == F.get("q", i - 1))))
    cuts = cuts.select("url_key", dense.alias("dense"), F.array_sort(F.array_distinct(F.concat("q", F.transform(dense, lambda x: x + 1)))).alias("cuts"))
    cuts = write_table(cuts, "revisit-cuts")
    deal = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")
    if few:
        met = r.join(F.broadcast(cuts), "url_key", "left")
    else:
        many = cuts.withColumn("deal", F.explode(F.sequence(zero, F.lit(SALTS - 1))))
        met = r.withColumn("deal", deal).join(many, ["url_key", "deal"], "left").drop("deal")
    block = F.size(F.filter("cuts", lambda x: x <= F.col("at")))
    salt = F.when(F.array_contains("dense", F.col("at")), deal)
    return met.select(*r.columns, F.when(usable & F.col("cuts").isNotNull(), block).otherwise(0).alias("block"), F.coalesce(salt, zero).alias("salt"))


def resolve(records: DataFrame) -> DataFrame:
    """record_id, url_key, refers_to, status and headers of every revisit."""
    r = blocks(records.select("record_id", "at", "kind", "headers", canonical(F.col("url")).alias("url_key")))
    usable = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    r = r.withColumn("full", F.when((F.col("kind") == "response") & usable, F.struct("at", "record_id", "headers")))
    # records that can't meet anything are dealt out by their id
    r = r.withColumn("salt", F.when(usable, F.col("salt")).otherwise(F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")))
    # at one time revisits stand before responses, which aren't earlier
    own = Window.partitionBy("url_key", "block", "salt").orderBy("at", F.col("full").isNotNull(), "record_id")
    within = r.withColumn("inside", F.last("full", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    revisits = within.filter(F.col("kind") == "revisit")

    last = r.filter(F.col("full").isNotNull()).groupBy("url_key", "block").agg(F.max_by("full", F.struct("at", "record_id")).alias("last"))
    # blocks in which a revisit found nothing look back too, whether or not they hold a response
    wanted = revisits.filter(F.col("inside").isNull() & usable).select("url_key", "block").distinct()
    marks = last.unionByName(wanted.select("url_key", "block", F.lit(None).cast(last.schema["last"].dataType).alias("last")))
    marks = marks.groupBy("url_key", "block").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url_key", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = revisits.join(carried, ["url_key", "block"], "left")
    found = found.withColumn("full", F.when(usable, F.coalesce("inside", "carried")))
    mine, theirs = F.col("headers"), F.col("full.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    agrees = F.when(tag(mine).isNotNull() & tag(theirs).isNotNull(), tag(mine) == tag(theirs)).otherwise(
        F.coalesce(mine["last-modified"] == theirs["last-modified"], F.lit(False))
    )
    status = F.when(F.col("full").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    over = F.map_filter(F.coalesce(mine, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(FIXED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)
    found = found.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return found.select("record_id", "url_key", F.when(ok, F.col("full.record_id")).alias("refers_to"), "status", F.when(ok, merged).alias("headers"))


def header_text(headers: Column) -> Column:
    """Headers as lines in order of their names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def crawl(pages: DataFrame, delay: int = 2000) -> DataFrame:
    """A crawl log of the pages: each was fetched at 2 * page_id and asked for again `delay` + 1 later with the
    tag that the fetch had given; the server said not modified."""
    tag = F.md5("html")
    common = [F.col("page_id"), F.col("url")]
    number = F.col("page_id").cast("string")
    first = pages.select(
        *common, (2 * F.col("page_id")).alias("record_id"), (2 * F.col("page_id")).alias("at"), F.lit("response").alias("kind"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("content-length"), F.coalesce(F.octet_length("html").cast("string"), F.lit("0")), F.lit("content-type"), F.lit("text/html"), F.lit("date"), number).alias("headers"),
    )
    again = pages.select(
        *common, (2 * F.col("page_id") + 1).alias("record_id"), (2 * F.col("page_id") + delay + 1).alias("at"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("etag"), tag, F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("+"), number)).alias("headers"),
    )
    return first.unionByName(again)


SQL = r"""
WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?', ''), '#.*$', '') AS bare FROM pages),
k AS (SELECT page_id, md5(html) AS tag, strlen(html) AS n,
  regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda a: a <> '' AND NOT regexp_matches(a, '^utm_'))) AS args FROM p),
u AS (SELECT page_id, tag, n, stem || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url_key FROM k),
j AS (SELECT v.page_id, v.url_key, v.tag, f.page_id AS of_page, f.tag AS of_tag, f.n AS of_n
  FROM u v ASOF LEFT JOIN u f ON v.url_key = f.url_key AND 2 * v.page_id + 2001 > 2 * f.page_id)
SELECT page_id, url_key, CASE WHEN tag = of_tag THEN 2 * of_page END AS refers_to,
  CASE WHEN of_page IS NULL THEN 'no_response' WHEN tag = of_tag THEN 'resolved' ELSE 'validator_mismatch' END AS status,
  CASE WHEN tag = of_tag THEN 'content-length: ' || of_n || chr(10) || 'content-type: text/html' || chr(10) || 'date: +' || page_id || chr(10) || 'etag: ' || tag END AS headers
FROM j"""
