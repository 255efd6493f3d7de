"""Operator 2, line dedup by site-relative frequency.

For each host, a line's frequency is the number of the host's pages that contain it over the number of the host's pages.
Lines above max_ratio, found on min_pages pages at least, are boilerplate and go from every page of that host.

Lines are compared trimmed, as 64-bit hashes: a line goes wrongly if its hash equals that of another line which is boilerplate of
its host, with odds of 1 in 2**64 for each such pair. Blank lines are no boilerplate and stay. Null text gives null text and no
line; null hosts form one host. Repeated rows count as pages of their own. A page may lose all its lines; the row stays with
empty text. Extra columns stay, whatever their names.

Pages never move to count lines: only (host, line, count) rows are shuffled, pre-aggregated. The found lines go to the pages by
broadcast if their counted number allows it; else hosts are salted, so that the pages of a hot host are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, near, table

MAX_RATIO, MIN_PAGES = 0.3, 3
#: Most hosts, and most line hashes of all hosts, that are broadcast (about 32 MB each); above, joins shuffle.
BROADCAST_HOSTS, BROADCAST_KEYS = 1 << 20, 1 << 22
SALTS = 32


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, lines: Column, host: Column, max_ratio: float, min_pages: int) -> DataFrame:
    """(site, keys): the hashes of each host's boilerplate lines.

    A host has no more of them than (mean distinct lines of its pages) / max_ratio, however many pages it has. Keys are
    counted after a partial aggregation, so hot hosts and hot lines reach the exchange as one row per task.
    """
    keys = F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _line_key))
    seen = pages.select(host.alias("host"), keys.alias("keys"))
    totals = checkpoint(seen.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("pages")))
    counts = seen.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    hot = counts.join(near(totals, BROADCAST_HOSTS), F.expr("host <=> site")).where(F.col("n") > max_ratio * F.col("pages"))
    return hot.groupBy("site").agg(F.collect_set("key").alias("keys"))


def dedup_lines(pages: DataFrame, lines: Column, host: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(row, all, kept) of every page: row holds all its columns, all and kept are its lines before and after."""
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), lines.alias("all"), host.alias("host"))
    found = checkpoint(boilerplate(pages, lines, host, max_ratio, min_pages))
    if (found.agg(F.sum(F.size("keys"))).first()[0] or 0) <= broadcast_keys:
        both = own.join(F.broadcast(found), F.expr("host <=> site"), "left")
    else:
        spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = own.withColumn("own_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, F.expr("host <=> site and own_salt = salt"), "left")
    here = F.array_intersect(F.transform("all", _line_key), "keys")  # by hash set; a page's own boilerplate lines are few
    marked = both.withColumn("here", F.when(F.col("keys").isNotNull() & F.col("all").isNotNull(), here))
    kept = F.filter("all", lambda x: ~F.array_contains("here", _line_key(x)))
    return marked.select("row", "all", F.when(F.coalesce(F.size("here"), F.lit(0)) <= 0, F.col("all")).otherwise(kept).alias("kept"))


def html_lines(html: Column) -> Column:
    """The visible text pieces of a page, in order: what stands between tags, without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "\n")
    return F.filter(F.transform(F.split(bare, r"<[^>]*>|\n"), lambda x: F.trim(x)), lambda x: x != "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = dedup_lines(pages, html_lines(F.col("html")), url_host(F.col("url")))
    return done.select(
        "row.page_id",
        url_host(F.col("row.url")).alias("host"),
        F.greatest(F.size("all"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("all") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """documents with the boilerplate lines of each source taken out of their texts; n_chars follows the text."""
    done = dedup_lines(docs, F.split("text", "\n"), F.col("source"), max_ratio, min_pages)
    text = F.array_join("kept", "\n")
    return done.select(*[(text if c == "text" else F.length(text).cast(docs.schema[c].dataType) if c == "n_chars" else F.col("row").getField(c)).alias(c) for c in docs.columns])


SQL = r"""
with p as (
  select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) as host,
    list_filter(list_transform(regexp_split_to_array(
      regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', chr(10), 'gis'), '<[^>]*>|\n'), lambda x: trim(x, ' ')), lambda x: x <> '') as ls
  from pages),
t as (select host, count(*) as pages from p group by host),
c as (select host, line, count(*) as n from (select host, unnest(list_distinct(ls)) as line from p) group by host, line),
b as (select c.host, list(line) as bs from c join t on c.host is not distinct from t.host where n >= 3 and n > 0.3 * pages group by c.host),
k as (select page_id, p.host, ls, list_filter(ls, lambda x: not list_contains(coalesce(bs, []), x)) as kept from p left join b on p.host is not distinct from b.host)
select page_id, host, coalesce(len(ls), 0) as n_lines, coalesce(len(ls) - len(kept), 0) as n_dropped,
  case when ls is null then null else coalesce(array_to_string(kept, chr(10)), '') end as text
from k
"""
