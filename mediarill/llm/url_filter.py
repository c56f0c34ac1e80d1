"""URL verdicts by host and path rules, spread over redirects and canonical links. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.shared import materialize, scratch
from .lines import ascii_lower

# The rules of the registered query, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_PARTS = "://([^/?#]*)([^?#]*)"
_CANONICAL = "(?is)<link\\b(?=[^>]*\\brel\\s*=\\s*[\"']?canonical\\b)[^>]*\\bhref\\s*=\\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\\s\"'>]+))"
_REFRESH = "(?is)<meta\\b(?=[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b)[^>]*\\bcontent\\s*=\\s*[\"'][^\"'>]*?url\\s*=\\s*['\"]?([^\"'>\\s]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def node_of(url: Column) -> Column:
    """A URL without its fragment, scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(url), "#.*", "")
    head = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return F.concat(ascii_lower(head), F.substr(bare, F.length(head) + 1))


def resolved(base: Column, link: Column) -> Column:
    """An absolute URL for a link found on the page ``base``."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    origin = F.regexp_extract(base, "^[^:/?#]+://[^/?#]*", 0)
    scheme = F.regexp_extract(base, "^([^:/?#]+):", 1)
    folder = F.regexp_extract(base, "^[^:/?#]+://[^/?#]*(?:[^?#]*/)?", 0)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)``: page and target nodes of canonical links and refresh redirects in ``html``."""
    html = F.coalesce("html", F.lit(""))
    canonical = F.concat(*[F.regexp_extract(html, _CANONICAL, i) for i in (1, 2, 3)])
    links = F.array(canonical, F.regexp_extract(html, _REFRESH, 1))
    found = pages.where(F.col("url").contains("://")).select("url", F.explode(F.filter(links, lambda x: x.isNotNull() & (x != ""))).alias("link"))
    found = found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.trim("url"), F.col("link"))).alias("b"))
    return found.where("b is not null and a <> b").distinct()


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, rule_host string, rule_path string")


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, rule, action)`` for each of the distinct ``urls`` that a rule fits; the longest rule wins.

    Each URL is looked up under its host and every parent of it, an equi-join
    whatever the number of rules. Of rules of one length the one with the
    longer host wins, then ``block``.
    """
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    asked = asked.select("url", "path", F.explode(parents).alias("rule_host"))
    hit = asked.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule), F.length("rule_host"), F.col("action"))
    return hit.groupBy("url").agg(F.max_by(F.struct(rule.alias("rule"), "action"), rank).alias("m")).select("url", "m.rule", "m.action")


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    A page that a rule fits has the rule's verdict. Other pages get their
    alias group's: groups are the connected components of redirects (meta
    refresh) and canonical links; a URL of the group that an allow rule fits
    makes the group allowed, else one that a block rule fits makes it
    blocked; else, and outside groups, a page is allowed.

    A null url, or one without ``://``, has an empty host and path, no rule
    and no group. Null html has no links. Repeated rows are each judged.
    Empty tables give empty results; other columns are not looked at.
    """
    pages = pages.select("page_id", "url", "html")
    with scratch():
        groups = connected_components(materialize(alias_edges(pages), "alias_edges"))
        urls = pages.select("url").where("url is not null").distinct()
        ruled = materialize(matched_rules(urls, rules), "ruled", kept=True)
        nodes = groups.select(F.col("node").alias("url"))
        of_nodes = matched_rules(nodes, rules).select(F.col("url").alias("node"), "action")
        decided = groups.join(of_nodes, "node").groupBy("component").agg(F.min("action").alias("group_action"))
        grouped = materialize(groups.join(decided, "component").select("node", "group_action"), "grouped", kept=True)
    # Tables of URLs unfold to a multiple of their files' size and grow with the pages: merged, never broadcast.
    out = pages.select("page_id", "url").join(ruled.hint("merge"), "url", "left")
    out = out.withColumn("node", node_of(F.col("url"))).join(grouped.hint("merge"), "node", "left")
    verdict = F.coalesce("action", "group_action", F.lit("allow"))
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", verdict.alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark, RULES))


OP8_SQL = """
WITH RECURSIVE rules(action, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
links AS (
  SELECT url AS a, regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*\\bhref\\s*=\\s*["'']?([a-z]+://[^"''>\\s]*)', 1) AS b FROM pages
  UNION SELECT url, regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*\\bcontent\\s*=\\s*["''][^"''>]*?url\\s*=\\s*["'']?([a-z]+://[^"''>\\s]*)', 1) FROM pages
),
edges AS (SELECT regexp_replace(a, '#.*', '') AS a, regexp_replace(b, '#.*', '') AS b FROM links WHERE b <> '' AND contains(a, '://')),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
urls AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM both_ways),
parts AS (
  SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM urls
),
fits AS (
  SELECT url, rh || rp AS rule, action, row_number() OVER (PARTITION BY url ORDER BY length(rh || rp) DESC, length(rh) DESC, action DESC) AS k
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
),
groups AS (SELECT reach.a AS node, min(action) AS action FROM reach JOIN fits ON reach.b = fits.url AND k = 1 GROUP BY reach.a)
SELECT p.page_id, coalesce(t.host, '') AS host, coalesce(t.path, '') AS path, f.rule, coalesce(f.action, g.action, 'allow') AS verdict
FROM pages p LEFT JOIN parts t ON p.url = t.url LEFT JOIN fits f ON p.url = f.url AND f.k = 1 LEFT JOIN groups g ON regexp_replace(p.url, '#.*', '') = g.node
"""
