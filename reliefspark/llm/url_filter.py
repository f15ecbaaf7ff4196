"""URL filter with redirect equivalence, with built-in functions only.

A rule (host, path) fits its host and all subdomains if the path of the url starts with the rule's; the longest one
decides, of equally long ones the last by verdict, host and path.  Rules are a table: each host meets the rules of its
suffixes once, and each url picks among those of its host, so a list of any length can be planned.
Pages without a rule take the decision of their component over redirect and canonical-link edges: allowed
if a member is allowed by rule, else blocked if a member is blocked by rule, else allowed.

Urls are nodes without scheme and fragment, the host in lower case.  A null url, or one without ``://``, has an empty
host and path, no node and no rule.  All canonical and refresh tags of a page count, but those in comments.  A link is
absolute if a scheme stands in front; other schemes than ``x://`` (``mailto:``) lead nowhere.  A null html has no links,
a very long one is looked through once from tag to tag.  Rows with the same url share a node.  Links to
places outside the table count as nodes too, and are judged by the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.common import ascii_lower
from reliefspark.llm.graph import components

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: what is no content; tags; which of them say where a page lives, and where it sends its readers; what they name
COMMENT = r"(?s)<!--.*?-->"
TAG = r"(?i)<(?:link|meta)\b[^<>]*>"
CANONICAL = r"(?i)^<link\b.*\brel\s*=\s*[\"']?canonical\b"
REFRESH = r"(?i)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(node: Column) -> Column:
    return F.regexp_extract(node, r"^[^/?#]*", 0)


def path_of(node: Column) -> Column:
    return F.regexp_extract(node, r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The url behind its scheme, without fragment, the host in lower case; null where there is no scheme."""
    rest = F.substr(url, F.position(F.lit("://"), url) + 3)
    return F.when(F.contains(url, F.lit("://")), F.concat(ascii_lower(host_of(rest)), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)))


def rules_of_hosts(hosts: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``host, rules`` for hosts (column ``host``) that any rule (``verdict, rule_host, rule_path``) may fit."""
    if not isinstance(rules, DataFrame):
        rules = hosts.sparkSession.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.select("host").where("host <> ''").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    one = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("length"), "verdict", "rule_host", "rule_path")
    return met.groupBy("host").agg(F.collect_set(one).alias("rules"))


def with_rule(urls: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """Rows with ``host`` and ``path``, and the longest fitting rule as ``said`` (struct of rule and verdict), null where none fits."""
    own = urls.join(rules_of_hosts(urls, rules), "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r.rule_path)))
    said = F.when(best.isNotNull(), F.struct(F.concat(best.rule_host, best.rule_path).alias("rule"), best.verdict.alias("verdict")))
    return own.withColumn("said", said).drop("rules")


def _resolved(link: Column, node: Column) -> Column:
    """The node a link of a page leads to: absolute, scheme-relative, from the root, a query, or beside the page."""
    host, path = host_of(node), path_of(node)
    beside = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    whole = (F.when(link.rlike(SCHEME + "//"), link).when(link.rlike(SCHEME), None).when(link.startswith("//"), F.concat(F.lit(":"), link))
             .when(link.startswith("/"), F.concat(F.lit("://"), host, link)).when(link.startswith("?"), F.concat(F.lit("://"), host, path, link))
             .when((link == "") | link.startswith("#"), None).otherwise(F.concat(F.lit("://"), host, beside, link)))
    return node_of(whole)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: nodes of pages and of their canonical and redirect targets."""
    html = F.col(html_col).cast("string")
    likely = pages.where(html.rlike(r"(?i)canonical|refresh")).select(node_of(F.col(url_col).cast("string")).alias("a"), F.regexp_replace(html, COMMENT, "").alias("html"))
    tags = likely.where("a is not null").select("a", F.explode(F.regexp_extract_all("html", F.lit(TAG), 0)).alias("tag")).select("a", F.regexp_replace("tag", r"\s", " ").alias("tag"))
    link = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1))
    links = tags.select("a", F.replace(link, F.lit("&amp;"), F.lit("&")).alias("link")).where("link <> ''")
    return links.select("a", _resolved(F.col("link"), F.col("a")).alias("b")).where("b is not null and a <> b")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, ``host``, ``path``, ``rule``, ``verdict`` and ``component`` (its smallest node; null for pages without links)."""
    comps = components(link_edges(pages, url_col, html_col))
    placed = with_rule(comps.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    decided = placed.groupBy("component").agg(F.max(F.col("said.verdict") == "allow").alias("allowed"), F.max(F.col("said.verdict") == "block").alias("blocked"))
    verdict = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    nodes = comps.join(decided, "component").select("node", "component", verdict.alias("shared"))
    own = pages.select(F.col(id_col).alias("row_id"), node_of(F.col(url_col).cast("string")).alias("node"))
    own = own.select("row_id", "node", F.coalesce(host_of(F.col("node")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("node")), F.lit("")).alias("path"))
    return with_rule(own, rules).join(nodes, "node", "left").select(
        F.col("row_id").alias(id_col), "host", "path", F.col("said.rule").alias("rule"), F.coalesce("said.verdict", "shared", F.lit("allow")).alias("verdict"), "component")
