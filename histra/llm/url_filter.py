r"""URL filter with dated lists.

A list is a table of dated entries: from `listed_on` on, a pattern (a host or a domain that covers all hosts below it) is put
on the list or taken off it. Per list, category and pattern the entries in order of date become validity intervals: an entry
holds until the next one, and only intervals that begin with "add" are kept. A capture (URL and day of fetch) is joined as of
its day: with the intervals of its host and of all domains above it that hold on that day.

The join runs on distinct (host, day) pairs, so a host with a third of all captures adds at most one row for each day, and the
verdicts are joined back on (host, day). Of a host's domains only those that stand on a list go into the as-of join; a domain
as common as "com" is dropped before anything is shuffled by it, as long as the listed patterns are few enough to be sent to
all tasks (LISTED_ROWS, counted first). Beyond that they are joined, and Spark splits a domain that is too common.

Defined results: a null URL, and one without a host, matches nothing and is kept; a capture without a day likewise; of
entries with one list, category, pattern and day "add" comes last and so holds; entries without day or pattern are left out;
rows that repeat a page are judged alike. Hosts are compared in small letters, without user, port and final dot. A host in
brackets (IPv6) and one of digits and dots (IPv4) has no domains above it. Captures keep all their columns, whatever their
names; of the four that are added, `host` and the others take the place of columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
#: Hosts without domains above them.
ADDRESS = r"^(\[.*|[0-9.]+)$"
NEVER = "9999-12-31"
#: Patterns that may be sent to all tasks: some 30 MB at 60 bytes each.
LISTED_ROWS = 500_000
VERDICT = ("n_active", "categories", "listed_since")


def host_of(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and all domains above it, down to the last label."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.rlike(host, F.lit(ADDRESS)), F.array(host)).otherwise(above)


def validity(entries: DataFrame) -> DataFrame:
    """entries: list, category, pattern, listed_on (date), action ("add" or "remove"). Intervals [valid_from, valid_to)."""
    rows = entries.filter("pattern is not null and listed_on is not null").withColumn("pattern", F.lower("pattern"))
    order = Window.partitionBy("list", "category", "pattern").orderBy("listed_on", F.col("action").desc_nulls_first())
    rows = rows.withColumn("valid_to", F.coalesce(F.lead("listed_on").over(order), F.to_date(F.lit(NEVER))))
    return rows.filter((F.col("action") == "add") & (F.col("listed_on") < F.col("valid_to"))).select("list", "category", "pattern", F.col("listed_on").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, listed_rows: int = LISTED_ROWS) -> DataFrame:
    """captures: url, fetched_on (date) and others. Adds host, n_active, categories, listed_since."""
    others = [c for c in captures.columns if c not in ("host", *VERDICT)]
    seen = captures.select(*[F.col(f"`{c}`") for c in others], host_of(F.col("url")).alias("_uf_host"), F.col("fetched_on").alias("_uf_on"))
    intervals = materialise(validity(entries))
    patterns = intervals.select("pattern").distinct()
    listed = F.broadcast(patterns) if patterns.count() <= listed_rows else patterns
    pairs = seen.select(F.col("_uf_host").alias("h"), F.col("_uf_on").alias("day")).filter("h is not null and day is not null").distinct()
    asked = pairs.select("h", "day", F.explode(domains_of(F.col("h"))).alias("pattern")).join(listed, "pattern", "left_semi")
    active = asked.join(intervals, "pattern").filter((F.col("day") >= F.col("valid_from")) & (F.col("day") < F.col("valid_to")))
    verdicts = active.groupBy(F.col("h").alias("_uf_h"), F.col("day").alias("_uf_day")).agg(
        F.count("*").alias("_uf_n"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("_uf_categories"), F.min("valid_from").alias("_uf_since")
    )
    joined = seen.join(verdicts, (F.col("_uf_host") == F.col("_uf_h")) & (F.col("_uf_on") == F.col("_uf_day")), "left")
    added = [F.coalesce("_uf_n", F.lit(0)).alias("n_active"), F.col("_uf_categories").alias("categories"), F.col("_uf_since").alias("listed_since")]
    return joined.select(*[F.col(f"`{c}`") for c in others], F.col("_uf_host").alias("host"), *added)


def filter_captures(captures: DataFrame, entries: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """The captures, all their columns, that no active entry (of the categories) covers."""
    wanted = entries if categories is None else entries.filter(F.col("category").isin(categories))
    # Columns with names of the verdict's are kept aside.
    aside = {c: f"_uf_was_{c}" for c in ("host", *VERDICT) if c in captures.columns}
    judged = evaluate(captures.withColumnsRenamed(aside), wanted).filter("n_active = 0")
    return judged.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in captures.columns])


#: The tables have neither lists nor days of fetch. The query takes both from rules: a page is fetched on a day given by its
#: number, and about a quarter of the hosts get dated entries by md5.
START, DAYS = "2020-01-01", 1461
CATEGORIES = ("adult", "malware", "phishing", "spam")


def _digest(text: Column, place: int) -> Column:
    return F.conv(F.substring(F.md5(text), place, 4), 16, 10).cast("int")


def sample_entries(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    hosts = hosts.filter(_digest(F.col("host"), 1) % 4 == 0)
    day = _digest(F.col("host"), 5) % 900
    category = F.when(F.contains("host", F.lit("spam")), F.lit("spam")).otherwise(F.array(*[F.lit(c) for c in CATEGORIES])[_digest(F.col("host"), 9) % len(CATEGORIES)])
    parent = F.when(F.rlike("host", F.lit(ADDRESS)), F.col("host")).otherwise(F.substring_index("host", ".", -2))
    pattern = F.when(_digest(F.col("host"), 13) % 16 == 0, parent).otherwise(F.col("host"))
    entry = lambda after, action: F.struct((day + after).alias("day"), F.lit(action).alias("action"))
    steps = F.array_compact(F.array(entry(0, "add"), F.when(_digest(F.col("host"), 17) % 2 == 0, entry(200, "remove")), F.when(_digest(F.col("host"), 21) % 3 == 0, entry(400, "add"))))
    return hosts.select(F.lit("sample").alias("list"), category.alias("category"), pattern.alias("pattern"), F.explode(steps).alias("e")).select(
        "list", "category", "pattern", F.date_add(F.to_date(F.lit(START)), F.col("e.day")).alias("listed_on"), F.col("e.action").alias("action")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.to_date(F.lit(START)), (F.pmod(F.col("page_id"), F.lit(DAYS))).cast("int"))
    judged = evaluate(pages.withColumn("fetched_on", fetched), sample_entries(pages))
    return judged.select(
        "page_id",
        "host",
        F.col("fetched_on").cast("string").alias("fetched_on"),
        "n_active",
        F.coalesce("categories", F.lit("")).alias("categories"),
        F.col("listed_since").cast("string").alias("listed_since"),
        (F.col("n_active") == 0).cast("int").alias("kept"),
    )


def oracle_sql() -> str:
    digest = lambda place: f"(('0x' || substr(md5(host), {place}, 4))::BIGINT)"
    names = ", ".join(f"'{c}'" for c in CATEGORIES)
    return f"""
WITH p AS (SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.'), '') AS host, DATE '{START}' + (((page_id % {DAYS}) + {DAYS}) % {DAYS})::INTEGER AS day FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
l AS (SELECT host, CASE WHEN contains(host, 'spam') THEN 'spam' ELSE [{names}][({digest(9)} % {len(CATEGORIES)}) + 1] END AS category,
             CASE WHEN {digest(13)} % 16 = 0 AND NOT regexp_matches(host, '{ADDRESS}') THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS pattern, {digest(5)} % 900 AS d FROM h WHERE {digest(1)} % 4 = 0),
e AS (SELECT category, pattern, d, 'add' AS action FROM l
      UNION ALL SELECT category, pattern, d + 200, 'remove' FROM l WHERE {digest(17)} % 2 = 0
      UNION ALL SELECT category, pattern, d + 400, 'add' FROM l WHERE {digest(21)} % 3 = 0),
v AS (SELECT *, DATE '{START}' + d::INTEGER AS valid_from, coalesce(DATE '{START}' + (lead(d) OVER (PARTITION BY category, pattern ORDER BY d, action DESC))::INTEGER, DATE '{NEVER}') AS valid_to FROM e),
q AS (SELECT DISTINCT host, day FROM p WHERE host IS NOT NULL),
s AS (SELECT host, day, unnest(CASE WHEN regexp_matches(host, '{ADDRESS}') THEN [host] ELSE list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END) AS pattern FROM q),
a AS (SELECT host, day, count(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, min(valid_from) AS since
      FROM s JOIN v USING (pattern) WHERE action = 'add' AND valid_from < valid_to AND day >= valid_from AND day < valid_to GROUP BY ALL)
SELECT page_id, p.host, p.day::VARCHAR AS fetched_on, coalesce(n, 0)::BIGINT AS n_active, coalesce(categories, '') AS categories, since::VARCHAR AS listed_since, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS kept
FROM p LEFT JOIN a ON p.host = a.host AND p.day = a.day"""
