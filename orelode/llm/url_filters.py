"""URL rules by host suffix and path prefix, whose blocks spread over redirects and canonical links.

A URL that rules fit has the verdict of the longest. Other URLs take part in equivalence classes: connected components
over redirect and canonical-link edges. A class with a blocked member is blocked, unless one of its members is allowed
by a rule of its own: an explicit allow goes before what spreads. All else is allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.llm.components import components, grouped_back
from orelode.llm.runtime import written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query: fixed values.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Links are read off tags, outside comments and scripts. The patterns mean the same to Java's engine and to RE2.
HIDDEN = r"(?is)<!--.*?-->|<script[ \t\n\f\r>].*?</script"
TAGS = r"(?is)<(?:link|meta|base)[ \t\n\f\r/][^>]*>"
CANONICAL = r"""(?is)^<link.*[ \t\n\f\r"'/]rel[ \t\n\f\r]*=[ \t\n\f\r]*(?:"(?:[^"]*[ \t\n\f\r])?canonical(?:[ \t\n\f\r][^"]*)?"|'(?:[^']*[ \t\n\f\r])?canonical(?:[ \t\n\f\r][^']*)?'|canonical[ \t\n\f\r/>])"""
REFRESHES = r"""(?is)^<meta.*[ \t\n\f\r"'/]http-equiv[ \t\n\f\r]*=[ \t\n\f\r]*["']?refresh["' \t\n\f\r/>]"""
HREF, CONTENT = (rf"""(?is)[ \t\n\f\r"'/]{name}[ \t\n\f\r]*=[ \t\n\f\r]*(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r"'>]+))""" for name in ("href", "content"))
URL_OF = r"""(?is)(?:^|[;, \t\n\f\r])url[ \t\n\f\r]*=[ \t\n\f\r]*["']?([^"' \t\n\f\r]+)"""
EDGES = r"^[ \t\n\f\r]+|[ \t\n\f\r]+$"


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as (name, verdict), or null; rules of one length in their given order."""
    out = F.lit(None).cast("struct<rule:string,own:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("own"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path from the root without its ``.`` and ``..`` segments."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def resolved(page: Column, link: Column) -> Column:
    """The URL that a link in a page means, or null if it is none: another scheme, or relative in a page without URL."""
    root, scheme = F.regexp_extract(page, r"(?s)^.*?://[^/?#]*", 0), F.regexp_extract(page, r"(?s)^(.*?:)//", 1)
    path, query = path_of(page), F.regexp_extract(page, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    own, rest = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    below = F.when(own == "", F.concat(path, F.when(rest.startswith("?"), "").otherwise(query))).when(own.startswith("/"), without_dots(own)).otherwise(without_dots(F.concat(folder, own)))
    absolute = link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.when(absolute, F.when(link.contains("://"), link)).when(page.contains("://"), F.when(link.startswith("//"), F.concat(scheme, link)).otherwise(F.concat(root, below, rest)))


def attribute(tag: Column, pattern: str) -> Column:
    """The value of a tag's attribute, quoted or not, with ``&amp;`` read and blanks around it cut; empty if there is none."""
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    return F.regexp_replace(F.replace(value, F.lit("&amp;"), F.lit("&")), EDGES, "")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a, b``: a page's URL and where its canonical links and refreshes point, relative ones resolved against it.

    A page's first ``base`` with a target takes its URL's place there.
    """
    low = F.lower(html)
    some = pages.filter(F.col(url).isNotNull() & (low.contains("canonical") | low.contains("refresh")))
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html), HIDDEN, ""), F.lit(TAGS), F.lit(0))
    rows = some.select(F.col(url).alias("a"), tags.alias("tags"))
    targets = F.transform("tags", lambda t: F.when(t.rlike(CANONICAL), attribute(t, HREF)).when(t.rlike(REFRESHES), F.regexp_extract(attribute(t, CONTENT), URL_OF, 1)).otherwise(""))
    bases = F.filter(F.transform("tags", lambda t: F.when(t.rlike("(?i)^<base"), attribute(t, HREF)).otherwise("")), lambda b: b != "")
    rows = rows.select("a", F.get(bases, F.lit(0)).alias("base"), F.explode(F.filter(targets, lambda t: t != "")).alias("b"))
    rows = rows.withColumn("page", F.coalesce(F.when(F.col("base").isNotNull(), resolved(F.col("a"), F.col("base"))), F.col("a")))
    return rows.select("a", resolved(F.col("page"), F.col("b")).alias("b")).filter("b IS NOT NULL AND a <> b")


def judged(pages: DataFrame, edges: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row.

    ``edges`` (a, b) are redirects besides the links that pages hold. URLs without ``://``, nulls too, have an empty
    host and path and no rule; nulls are in no class. Repeated rows and null keys stay, other columns go, and an empty
    table gives an empty one.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("found", ruled(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "found.rule", "found.own")
    links = page_links(pages, url, html)
    if edges is not None:
        links = links.unionByName(edges.select(F.col("a").cast("string"), F.col("b").cast("string")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b"))
    classes = written(components(written(links)))
    members = classes.withColumn("own", ruled(host_of(F.col("node")), path_of(F.col("node")), rules)["own"])
    blocked = F.bool_or(F.coalesce(F.col("own") == "block", F.lit(False))) & ~F.bool_or(F.coalesce(F.col("own") == "allow", F.lit(False)))
    spread = grouped_back(members, "component", blocked, "spread", classes.count()).filter("spread AND own IS NULL").select(F.col("node").alias("url"), "spread")
    return rows.join(spread, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("spread"), "block"), F.lit("allow")).alias("verdict"))


def resolving_sql(name: str, rows: str) -> str:
    """Common table expressions that end with ``name`` (r, a, b): the links of ``rows`` (r, a, page, link) resolved."""
    return rf"""
{name}_parts AS (
    SELECT r, a, page, link, regexp_extract(page, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(page, '(?s)^.*?://[^?#]*(\?[^#]*)?', 1) AS query,
        regexp_extract(page, '(?s)^.*?://[^/?#]*', 0) AS root, regexp_extract(page, '(?s)^(.*?:)//', 1) AS scheme,
        regexp_extract(link, '(?s)^[^?#]*', 0) AS own, regexp_extract(link, '(?s)^[^?#]*(.*)$', 1) AS rest FROM {rows}
), {name}_walks AS (
    SELECT *, CASE WHEN starts_with(own, '/') THEN own WHEN own <> '' THEN (CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^.*/', 0) END) || own END AS walk FROM {name}_parts
), {name}_kept AS (
    SELECT *, string_split(walk, '/')[2:] AS steps, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(walk, '/')[2:], lambda p: [p])),
        lambda acc, x: CASE WHEN x[1] = '..' THEN list_slice(acc, 1, greatest(len(acc) - 1, 0)) WHEN x[1] = '.' THEN acc ELSE acc || x END) AS kept FROM {name}_walks
), {name} AS (
    SELECT r, a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN CASE WHEN contains(link, '://') THEN link END
        WHEN contains(page, '://') THEN CASE WHEN starts_with(link, '//') THEN scheme || link
            ELSE root || CASE WHEN own = '' THEN path || CASE WHEN starts_with(rest, '?') THEN '' ELSE query END
                WHEN contains(walk, '/.') THEN '/' || array_to_string(kept, '/') || CASE WHEN steps[-1] IN ('.', '..') AND len(kept) > 0 THEN '/' ELSE '' END
                ELSE walk END || rest END END AS b
    FROM {name}_kept
)"""


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def attribute_sql(pattern: str) -> str:
    value = " || ".join(f"regexp_extract(tag, {quoted(pattern)}, {k})" for k in (1, 2, 3))
    return f"regexp_replace(replace({value}, '&amp;', '&'), {quoted(EDGES)}, '', 'g')"


SQL = rf"""
WITH RECURSIVE pages_ AS (
    SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS html,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules(verdict, host, path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), listed AS (
    SELECT r, url AS a, regexp_extract_all(regexp_replace(html, {quoted(HIDDEN)}, '', 'g'), {quoted(TAGS)}) AS tags FROM pages_ WHERE url IS NOT NULL
), tags AS (
    SELECT r, a, unnest(tags) AS tag, unnest(range(len(tags))) AS nth FROM listed
), base_tags AS (
    SELECT r, a, a AS page, arg_min(target, nth) AS link FROM (SELECT r, a, nth, {attribute_sql(HREF)} AS target FROM tags WHERE regexp_matches(tag, '(?i)^<base')) WHERE target <> '' GROUP BY r, a
), {resolving_sql("bases", "base_tags")}, found AS (
    SELECT r, a, CASE WHEN regexp_matches(tag, {quoted(CANONICAL)}) THEN {attribute_sql(HREF)}
        WHEN regexp_matches(tag, {quoted(REFRESHES)}) THEN regexp_extract({attribute_sql(CONTENT)}, {quoted(URL_OF)}, 1) END AS link FROM tags
), targets AS (
    SELECT found.r, found.a, coalesce(bases.b, found.a) AS page, link FROM found LEFT JOIN bases USING (r) WHERE link <> ''
), {resolving_sql("edges", "targets")}, both_ways AS (
    SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT b, a FROM edges WHERE b IS NOT NULL
), reach(a, b) AS (
    SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), nodes AS (
    SELECT a AS url, translate(regexp_extract(a, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT DISTINCT a FROM both_ways)
), owns AS (
    SELECT n.url, arg_max(r.verdict, length(r.host || r.path)) AS own FROM nodes n JOIN rules r
        ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY n.url
), spread AS (
    SELECT reach.a AS url, bool_or(own = 'block') AND NOT bool_or(own = 'allow') AS hit FROM reach JOIN owns ON reach.b = owns.url GROUP BY reach.a
), best AS (
    SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS own
    FROM (SELECT DISTINCT host, path FROM pages_) p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY p.host, p.path
)
SELECT page_id, p.host, p.path, rule, coalesce(own, CASE WHEN hit THEN 'block' END, 'allow') AS verdict
FROM pages_ p LEFT JOIN best USING (host, path) LEFT JOIN spread USING (url)
"""
