"""Site files and the crawl frontier: robots rules, sitemaps and breadth-first discovery as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import urls as U


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, group, agents array<string>, key, value, place) of robots files (host, body).

    A group is a run of user-agent lines and the directives after it. Comments go; keys are lower-case.
    """
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("place", "line")).withColumn("line", F.regexp_replace("line", "#.*$", "")).where(F.instr("line", ":") > 0)
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.substring(F.col("line"), F.instr("line", ":") + 1, F.length("line")))
    known = lines.select("host", "place", key.alias("key"), value.alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay", "request-rate", "sitemap"))
    w = Window.partitionBy("host").orderBy("place")
    ruled = known.where("key <> 'sitemap'")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    grouped = ruled.withColumn("group", F.sum(begins.cast("int")).over(w)).where(F.col("group") > 0)
    agents = grouped.where("key = 'user-agent'").groupBy("host", "group").agg(F.collect_set(F.lower("value")).alias("agents"))
    return grouped.where("key <> 'user-agent'").join(agents, ["host", "group"]).select("host", "group", "agents", "key", "value", "place")


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(host, value) of the sitemap lines of robots files (host, body), whatever group they stand in."""
    lines = files.select("host", F.explode(F.split("body", r"\r?\n")).alias("line"))
    return lines.where(F.lower(F.trim(F.substring_index("line", ":", 1))) == "sitemap").select("host", F.trim(F.regexp_extract("line", r"^[^:]*:([^#]*)", 1)).alias("value"))


def robots_for(rules: DataFrame, agent: str) -> DataFrame:
    """The rules of the groups that name the agent most closely; `*` is the least close."""
    strength = F.array_max(F.transform("agents", lambda a: F.when(a == "*", 0).when((a != "") & F.lit(agent.lower()).contains(a), F.length(a))))
    w = Window.partitionBy("host")
    return rules.withColumn("__s", strength).where("__s IS NOT NULL").withColumn("__m", F.max("__s").over(w)).where("__s = __m").drop("__s", "__m")


def robots_pattern(value: Column) -> Column:
    """A rule's path as a regular expression: * is anything, a last $ the end."""
    bare = F.regexp_replace(value, r"\$$", "")
    quoted = F.concat(F.lit(r"^\Q"), F.replace(bare, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"))
    return F.concat(quoted, F.when(value.endswith("$"), "$").otherwise(""))


def allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """urls (url) with allowed: the longest fitting rule decides, ties allow, no rule allows."""
    own = robots_for(rules, agent).where(F.col("key").isin("allow", "disallow") & (F.col("value") != "")).select("host", "key", F.url_decode("value").alias("value"))
    placed = urls.withColumns({"host": U.host(F.col("url")), "__p": F.url_decode(F.concat(U.path(F.col("url")), F.coalesce(F.concat(F.lit("?"), F.nullif(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit(""))), F.lit(""))))})
    met = placed.join(own, "host", "left")
    fits = F.rlike(F.col("__p"), robots_pattern(F.col("value")))
    best = F.max(F.when(fits, F.struct(F.length(F.replace(F.regexp_replace("value", r"\$$", ""), F.lit("*"), F.lit(""))).alias("n"), (F.col("key") == "allow").alias("a"))))
    return met.groupBy(*urls.columns).agg(F.coalesce(best["a"], F.lit(True)).alias("allowed"))


def robots_delays(rules: DataFrame, agent: str) -> DataFrame:
    """(host, crawl_delay, seconds_per_request): the greatest valid ones."""
    own = robots_for(rules, agent)
    delay = F.when(F.col("key") == "crawl-delay", F.expr("try_cast(value AS double)"))
    pair = F.regexp_extract("value", r"^\s*(\d+)\s*/\s*(\d+)\s*$", 1).try_cast("int"), F.regexp_extract("value", r"^\s*(\d+)\s*/\s*(\d+)\s*$", 2).try_cast("int")
    rate = F.when((F.col("key") == "request-rate") & (pair[0] > 0) & (pair[1] > 0), pair[1] / pair[0])
    return own.groupBy("host").agg(F.coalesce(F.max(F.when(delay.between(0, 86400), delay)), F.lit(0.0)).alias("crawl_delay"), F.max(rate).alias("seconds_per_request"))


def sitemap_locations(files: DataFrame) -> DataFrame:
    """(url, kind, location) of sitemap files (url, body): kind page or sitemap; no rows for files with a DOCTYPE, an entity or NUL."""
    safe = files.where(~F.col("body").rlike(r"(?i)<!(doctype|entity)|\x00"))
    kind = F.when(F.col("body").rlike(r"(?s)<(\w+:)?urlset[\s>]"), "page").when(F.col("body").rlike(r"(?s)<(\w+:)?sitemapindex[\s>]"), "sitemap")
    found = F.regexp_extract_all("body", F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), 1)
    rows = safe.select("url", kind.alias("kind"), F.explode(found).alias("location")).where("kind IS NOT NULL")
    return rows.where(U.origin(F.col("location")) == U.origin(F.col("url"))).select("url", "kind", F.replace("location", F.lit("&amp;"), F.lit("&")).alias("location")).distinct()


def sitemap_seeds(rules: DataFrame, home: str, fetch: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str, max_files: int = 50, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(seeds (url), report): the pages that a site's sitemaps list, indexes followed level by level.

    rules is (host, value) of robots files' sitemap lines; without any, /sitemap.xml is tried. fetch takes (url) and
    returns (url, html). Each file is fetched once; at most `max_files` files and `max_depth` levels of indexes are
    read, and report is one row (files, cut) whose cut names what these limits left out. Only pages in the home
    page's scope are seeds.
    """
    origin = U.canonical(home).split("/", 3)
    start = "/".join(origin[:3])
    named = rules.where(F.col("host") == F.lit(origin[2].split(":")[0])).select(U.canonical_url(F.col("value")).alias("url")).where(F.col("url").startswith(start + "/")).distinct()
    wanted = named if not named.isEmpty() else spark.createDataFrame([(f"{start}/sitemap.xml",)], "url string")
    read, cut = 0, []
    for depth in range(max_depth + 1):
        room = max_files - read
        if wanted.count() > room:
            cut.append("max_files")
            wanted = wanted.orderBy("url").limit(room)
        wanted.write.parquet(f"{folder}/asked/step={depth}")
        asked = spark.read.parquet(f"{folder}/asked/step={depth}")
        read += asked.count()
        found = sitemap_locations(fetch(asked).select("url", F.col("html").alias("body")))
        found.select("kind", U.canonical_url(F.col("location")).alias("url")).where("url IS NOT NULL").distinct().write.parquet(f"{folder}/listed/step={depth}")
        listed = spark.read.parquet(f"{folder}/listed/step={depth}")
        wanted = listed.where("kind = 'sitemap'").select("url").distinct().join(spark.read.parquet(f"{folder}/asked").select("url"), "url", "left_anti")
        if wanted.isEmpty():
            break
        if depth == max_depth:
            cut.append("max_depth")
        if read >= max_files:
            cut.append("max_files")
            break
    pages = spark.read.parquet(f"{folder}/listed").where("kind = 'page'").where(U.in_scope(F.col("url"), home)).select("url").distinct()
    return pages, spark.createDataFrame([(read, list(dict.fromkeys(cut)))], "files long, cut array<string>")


def fetch_schedule(urls: DataFrame, delays: DataFrame, least_delay: float = 0.0, after: DataFrame | None = None) -> DataFrame:
    """urls (url, place) with host and not_before: seconds from the crawl's begin at which each may be fetched.

    Fetches of a host are as far apart as the greatest of its crawl delay, its request rate and `least_delay`, in order of
    place; hosts don't wait for each other. after (host, free_at) is when each host may be asked next.
    """
    placed = urls.withColumn("host", U.host(F.col("url")))
    wait = F.greatest(F.coalesce("crawl_delay", F.lit(0.0)), F.coalesce("seconds_per_request", F.lit(0.0)), F.lit(least_delay))
    paced = placed.join(delays.select("host", "crawl_delay", "seconds_per_request"), "host", "left").withColumn("wait", wait)
    paced = paced.join(after, "host", "left") if after is not None else paced.withColumn("free_at", F.lit(0.0))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("place", "url")) - 1
    return paced.select(*urls.columns, "host", (F.coalesce("free_at", F.lit(0.0)) + turn * F.col("wait")).alias("not_before"), "wait")


def discover(
    home: str,
    fetch: Callable[[DataFrame], DataFrame],
    spark: SparkSession,
    folder: str,
    max_depth: int = 4,
    max_pages: int | None = 200,
    max_urls: int | None = 2000,
    seeds: DataFrame | None = None,
    rules: DataFrame | None = None,
    agent: str = "*",
    least_delay: float = 0.0,
    max_seconds: float | None = None,
    max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(pages (url, depth, html, place), report): the pages of a site by breadth-first search, one join for each depth.

    fetch takes a DataFrame (url, not_before) and returns (url, html) of those that could be fetched; not_before is
    fetch_schedule()'s. Each depth's pages are written to `folder` before their links are read, so every page is fetched
    once. URLs are taken in breadth-first order: by depth, then by the place of the page that links to them first, then by
    URL; place is that order. seeds (url), of sitemaps say, are at depth 0 after the home page. rules are
    robots_rules(): what they disallow for `agent` is not fetched, and their delays pace the schedule. The
    limits stop the search at so many URLs seen, pages fetched, seconds of the schedule and bytes of pages (None: no
    limit; pages beyond the bytes are fetched and left out); report is one row (pages, urls, unfetched, disallowed,
    seconds, bytes, cut), whose cut names the limits that left something out.
    """
    from gleaner.sources.pages import links

    start = U.canonical(home)
    frontier = spark.createDataFrame([(start, 0)], "url string, place long")
    fetched, depth, cut, unfetched, disallowed, seconds, size = 0, 0, [], 0, 0, 0.0, 0
    if seeds is not None:
        given = seeds.select("url").where((F.col("url") != start) & U.in_scope(F.col("url"), home)).distinct()
        if max_urls is not None and given.count() > max_urls - 1:
            cut.append("max_urls")
            given = given.orderBy("url").limit(max_urls - 1)
        given.withColumn("parent", F.lit(0).cast("long")).write.parquet(f"{folder}/seeds")
        frontier = frontier.unionByName(_numbered(spark.read.parquet(f"{folder}/seeds"), 1))
    seen = frontier.count()
    none = spark.createDataFrame([], "host string, crawl_delay double, seconds_per_request double")
    delays = none if rules is None else robots_delays(rules, agent)
    free: DataFrame | None = None
    while True:
        wanted = frontier
        if rules is not None:
            judged = allowed(frontier, rules, agent)
            wanted = judged.where("allowed").drop("allowed")
            disallowed += frontier.count() - wanted.count()
        room = None if max_pages is None else max_pages - fetched
        if room is not None and wanted.count() > room:
            cut.append("max_pages")
            wanted = wanted.orderBy("place").limit(room)
        fetch_schedule(wanted, delays, least_delay, free).write.parquet(f"{folder}/schedule/step={depth}")
        planned = spark.read.parquet(f"{folder}/schedule/step={depth}")
        if max_seconds is not None:
            late = planned.where(F.col("not_before") > max_seconds)
            if not late.isEmpty():
                cut.append("max_seconds")
                planned = planned.where(F.col("not_before") <= max_seconds)
        got = fetch(planned.select("url", "not_before")).select("url", "html")
        planned.join(got, "url").select("url", F.lit(depth).alias("depth"), "html", "place").write.parquet(f"{folder}/got/step={depth}")
        frontier.select("url").write.parquet(f"{folder}/urls/step={depth}")
        here = spark.read.parquet(f"{folder}/got/step={depth}")
        unfetched += planned.count() - here.count()
        if max_bytes is not None:
            here = _within_bytes(here, max_bytes - size)
        here.write.parquet(f"{folder}/pages/step={depth}")
        kept = spark.read.parquet(f"{folder}/pages/step={depth}")
        if max_bytes is not None and kept.count() < here.sparkSession.read.parquet(f"{folder}/got/step={depth}").count():
            cut.append("max_bytes")
        here = kept
        n = here.count()
        fetched += n
        size += here.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
        paced = spark.read.parquet(f"{folder}/schedule").groupBy("host").agg(F.max(F.col("not_before") + F.col("wait")).alias("free_at"))
        seconds = planned.agg(F.max("not_before")).first()[0] or seconds
        free = paced
        known = spark.read.parquet(f"{folder}/urls")
        found = links(here).join(here.select("url", "place"), "url").where(U.in_scope(F.col("link"), home)).groupBy(F.col("link").alias("url")).agg(F.min("place").alias("parent"))
        fresh = found.join(known.select("url"), "url", "left_anti")
        fresh.write.parquet(f"{folder}/found/step={depth}")
        fresh = spark.read.parquet(f"{folder}/found/step={depth}")
        count = fresh.count()
        full = [c for c in ("max_pages", "max_seconds", "max_bytes") if c in cut]
        if depth == max_depth or not count or full:
            if count and not full:
                cut.append("max_depth")
            break
        if max_urls is not None and seen + count > max_urls:
            cut.append("max_urls")
            fresh = fresh.orderBy("parent", "url").limit(max(0, max_urls - seen))
            count = min(count, max_urls - seen)
        frontier = _numbered(fresh, seen)
        seen += count
        depth += 1
        if not count:
            break
    report = spark.createDataFrame([(fetched, seen, unfetched, disallowed, float(seconds), size, list(dict.fromkeys(cut)))], "pages long, urls long, unfetched long, disallowed long, seconds double, bytes long, cut array<string>")
    return spark.read.parquet(f"{folder}/pages").drop("step"), report


def _within_bytes(pages: DataFrame, most: int) -> DataFrame:
    """The first pages in order of place whose bytes together stay within `most`: sums of parts first, then within each."""
    ranged = pages.select("url", "place", F.octet_length("html").cast("long").alias("n")).repartitionByRange("place").sortWithinPartitions("place").withColumn("p", F.spark_partition_id())
    w = Window.orderBy("p")
    before = ranged.groupBy("p").agg(F.sum("n").alias("s")).withColumn("before", F.sum("s").over(w) - F.col("s"))  # one row for each range
    summed = F.sum("n").over(Window.partitionBy("p").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = ranged.withColumn("own", summed).join(F.broadcast(before.select("p", "before")), "p").where(F.col("before") + F.col("own") <= most)
    return pages.join(kept.select("url"), "url", "left_semi")


def _numbered(fresh: DataFrame, after: int) -> DataFrame:
    """(url, place): rows in order of (parent, url), numbered on from `after`: counts of ranges first, then places within each."""
    ranged = fresh.repartitionByRange("parent", "url").sortWithinPartitions("parent", "url").select("url", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    w = Window.orderBy("p")
    ranged = ranged.withColumn("i", F.col("m") - (F.col("p").cast("long") * (1 << 33)))
    before = ranged.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(w) - F.col("n"))  # one row for each range
    return ranged.join(F.broadcast(before.select("p", "before")), "p").select("url", (F.col("before") + F.col("i") + after).alias("place"))
