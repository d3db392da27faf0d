"""URL filters: a sort-merge range join of urls with nested prefix rules.

A rule is a host and a path prefix; it holds for the host, all its
subdomains and every path that starts with the prefix. Hosts are compared
with their labels reversed (``com.example.www``), so each host suffix of a url
is one canonical key ``reversed suffix + path`` and each rule is the interval
of keys that start with the rule's key. Intervals of prefixes either nest or
are disjoint, so a sweep over the sorted keys needs only a stack of the rules
that are open. Each rule carries the stack as it is just after the rule opens;
the sweep carries the latest stack forward to the urls behind it, and a url
pops those that have ended: what is left on top is its longest rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii

#: Rule hosts up to this many are sent to all executors; more are joined by a shuffle.
BROADCAST_HOSTS = 20_000
#: Urls of a host and salt that one sweep sorts together, if its rules are fewer.
SWEEP_ROWS = 1024


def url_parts(url) -> tuple:
    """(host, path) columns: both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none) and verdict; one row per input row.

    ``rules``: host, path, verdict. The longest rule that fits wins, counted in
    characters of host and path together, then the longer host. Of equal
    rules with different verdicts ``block`` wins. Rules with a null or empty
    host are ignored, a null path counts as empty. A null url, an empty one or one
    without ``://`` has an empty host and path and gets ``default``. Repeated urls
    are judged once and all their rows kept. No rules or no pages: every row
    gets ``default``, or there are no rows. Columns of ``pages`` named host, path,
    rule or verdict are replaced; all others pass through.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "__url")]
    pages = pages.select(*keep, F.col(url).alias("__url"))
    host, path = url_parts(F.col("__url"))
    judged = pages.select(*keep, host.alias("host"), path.alias("path"))
    r = _stacked(rules)
    depth = r.agg(F.max(F.size(F.split("rhost", r"\.")))).first()[0] or 0
    if not depth:
        return judged.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.reverse(F.split("host", r"\."))
    keys = (
        judged.where("host <> ''").select("host", "path").distinct()
        .select("host", "path", labels.alias("labels"))
        .select("host", "path", "labels", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(depth)))).alias("k"))
        .select("host", "path", F.array_join(F.slice("labels", 1, F.col("k")), ".").alias("rhost"))
    )
    hosts = r.groupBy("rhost").agg(F.count("*").alias("n_rules"))
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    keys = keys.join(hosts, "rhost")
    # a hot host is swept in several strands, each with its own copy of the host's rules
    strands = keys.groupBy("rhost").agg(
        F.ceil(F.count("*") / F.greatest(F.max("n_rules"), F.lit(SWEEP_ROWS))).cast("int").alias("strands")
    )
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        strands = F.broadcast(strands)
    events = (
        keys.join(strands, "rhost")
        .select("rhost", F.pmod(F.xxhash64("host", "path"), F.col("strands").cast("bigint")).cast("int").alias("strand"),
                "path", F.lit(1).alias("is_url"), "host", F.lit(None).cast(r.schema["stack"].dataType).alias("stack"))
        .unionByName(
            r.join(strands, "rhost")
            .select("rhost", F.explode(F.sequence(F.lit(0), F.col("strands") - 1)).alias("strand"),
                    "path", F.lit(0).alias("is_url"), F.lit(None).cast("string").alias("host"), "stack")
        )
    )
    sweep = Window.partitionBy("rhost", "strand").orderBy("path", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    top = F.try_element_at(
        F.filter(F.col("open"), lambda s: F.col("path").startswith(s["path"])), F.lit(-1)
    )
    hits = (
        events.select("*", F.last("stack", ignorenulls=True).over(sweep).alias("open"))
        .where("is_url = 1").select("host", "path", top.alias("top")).where("top IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("top.host") + F.length("top.path")).alias("n"), F.length("top.host").alias("h"), F.col("top").alias("top"))).alias("best"))
        .select("host", "path", F.concat("best.top.host", "best.top.path").alias("rule"), F.col("best.top.verdict").alias("verdict"))
    )
    return judged.join(hits, ["host", "path"], "left").select(
        *keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def _stacked(rules: DataFrame) -> DataFrame:
    """Rules with ``stack``: the rules of the same host open just after this one opens, outermost first."""
    r = (
        rules.where("host IS NOT NULL AND host <> '' AND verdict IS NOT NULL")
        .select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select("host", "path", "verdict", F.array_join(F.reverse(F.split("host", r"\.")), ".").alias("rhost"))
    )
    outer = r.select("rhost", F.col("path").alias("prefix"), F.struct("path", "host", "verdict").alias("open"))
    heads = r.select("rhost", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    heads = heads.select("rhost", "path", F.expr("left(path, n)").alias("prefix"))
    return heads.join(outer, ["rhost", "prefix"]).groupBy("rhost", "path").agg(F.array_sort(F.collect_list("open")).alias("stack"))
