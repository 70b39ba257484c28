"""URL filters over time: dated list entries become validity intervals, captures meet those active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An entry that no later one closes is active for good.
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and a final dot; empty if the URL has none."""
    authority = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_extract(authority, r"([^@:]*?)\.?(:[0-9]*)?$", 1)


def first_segment(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """pattern, action, active_from, active_until (exclusive) from dated entries (pattern, listed_on, action).

    A pattern's entry holds until its next one. Of several on one day the greatest action wins. Entries with a null
    pattern, date or action say nothing.
    """
    daily = entries.dropna(subset=["pattern", "listed_on", "action"]).groupBy("pattern", "listed_on").agg(F.max("action").alias("action"))
    following = Window.partitionBy("pattern").orderBy("listed_on")
    return daily.select(
        "pattern",
        "action",
        F.col("listed_on").alias("active_from"),
        F.coalesce(F.lead("listed_on").over(following), F.lit(FOREVER).cast("date")).alias("active_until"),
    )


def capture_patterns(host: Column, segment: Column) -> Column:
    """Every pattern that can match a capture, most specific first: host and segment, host, then its parents.

    A parent has at least two labels, so their number is bounded by the host's labels.
    """
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = F.when(F.size(labels) >= 2, parents).otherwise(F.array(host))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(host, F.lit("/"), segment)), hosts))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_on, n_captures, action, pattern, active_from: the verdict on each capture.

    captures has page_id, url, fetched_on; entries has pattern, listed_on, action. The most specific pattern with an
    entry active on the day of the fetch decides; without one, action and pattern are null. A null URL or day, or
    a URL without host, matches nothing. Equal rows come out once, with their number. The join is an equi-join on the
    pattern with the interval beside it, so a host with a third of all captures is one that adaptive execution
    splits; the list is broadcast only where Spark has measured it to be small.
    """
    asked = captures.groupBy("page_id", "url", "fetched_on").agg(F.count("*").alias("n_captures"))
    probes = asked.select("*", F.posexplode_outer(capture_patterns(host_of(F.col("url")), first_segment(F.col("url")))).alias("rank", "probe"))
    on = (F.col("probe") == F.col("pattern")) & (F.col("active_from") <= F.col("fetched_on")) & (F.col("fetched_on") < F.col("active_until"))
    hit = F.when(F.col("pattern").isNotNull(), F.struct("rank", "action", "pattern", "active_from"))
    judged = probes.join(validity(entries), on, "left").groupBy("page_id", "url", "fetched_on", "n_captures").agg(F.min(hit).alias("hit"))
    return judged.select("page_id", "url", "fetched_on", "n_captures", "hit.action", "hit.pattern", "hit.active_from")


def fetch_day(page_id: Column) -> Column:
    """The pages carry no date; their ids are spread over the days of 2024."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id, F.lit(366)).cast("int"))


#: Versions of the list that pages are checked against.
LIST_VERSIONS = 4


def listed_patterns(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts and first segments of the pages themselves.

    Each pattern appears in some of LIST_VERSIONS quarterly versions, on a day and with an action that its MD5 gives.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), first_segment(F.col("url")).alias("segment")).filter("host <> ''").distinct()
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    patterns = hosts.select(F.explode(F.array(F.col("host"), F.concat("host", F.lit("/"), "segment"), parent)).alias("pattern")).filter("pattern <> ''").distinct()
    dated = patterns.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(LIST_VERSIONS - 1))).alias("v"))
    dated = dated.withColumn("digest", F.md5(F.concat_ws("@", "pattern", "v").cast("binary")))
    day = F.conv(F.substring("digest", 1, 4), 16, 10).cast("int") % 91
    action = F.when(F.substring("digest", 5, 1) < "7", "block").when(F.substring("digest", 5, 1) < "b", "allow").otherwise("clear")
    return dated.filter(F.substring("digest", 6, 1) < "8").select("pattern", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("v") * 91 + day).cast("int")).alias("listed_on"), action.alias("action"))


def page_verdicts(pages: DataFrame) -> DataFrame:
    captures = pages.select("page_id", "url", fetch_day(F.col("page_id")).alias("fetched_on"))
    return filter_captures(captures, listed_patterns(pages))


ORACLE_SQL = f"""
WITH page AS (
  SELECT page_id, url, regexp_extract(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '([^@:]*?)\\.?(:[0-9]*)?$', 1) AS host,
         regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS segment,
         DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on
  FROM pages
), pattern AS (
  SELECT DISTINCT unnest([host, host || '/' || segment, regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1)]) AS pattern FROM page WHERE host <> ''
), dated AS (
  SELECT pattern, v, md5(pattern || '@' || v) AS digest FROM pattern, unnest(range({LIST_VERSIONS})) r(v) WHERE pattern <> ''
), entry AS (
  SELECT pattern, DATE '2024-01-01' + CAST(v * 91 + CAST('0x' || digest[1:4] AS INTEGER) % 91 AS INTEGER) AS listed_on,
         max(CASE WHEN digest[5] < '7' THEN 'block' WHEN digest[5] < 'b' THEN 'allow' ELSE 'clear' END) AS action
  FROM dated WHERE digest[6] < '8' GROUP BY ALL
), asked AS (SELECT page_id, url, host, segment, fetched_on, count(*) AS n_captures FROM page GROUP BY ALL),
hit AS (
  SELECT a.*, e.action, e.pattern, e.listed_on AS active_from,
         row_number() OVER (PARTITION BY a.page_id, a.url ORDER BY CASE WHEN e.pattern = a.host || '/' || a.segment THEN 0 ELSE 1 END, length(e.pattern) DESC, e.listed_on DESC) AS rank
  FROM asked a LEFT JOIN entry e ON (e.pattern = a.host || '/' || a.segment OR e.pattern = a.host OR (ends_with(a.host, '.' || e.pattern) AND contains(e.pattern, '.')))
   AND e.listed_on <= a.fetched_on AND NOT EXISTS (SELECT 1 FROM entry l WHERE l.pattern = e.pattern AND l.listed_on > e.listed_on AND l.listed_on <= a.fetched_on)
)
SELECT page_id, url, fetched_on, n_captures, action, pattern, active_from FROM hit WHERE rank = 1
"""
