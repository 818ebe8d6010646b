"""URL filters by redirect equivalence.

URLs are brought to a normal form (no scheme, user, usual port, fragment or tracking parameter; no www. or m. before a host of two
labels or more; no index, .html ending or closing slash where no query follows; lower-case host), which joins those that every site redirects to each other. Edges are redirects (a table, and
refresh tags in the page) and canonical links in the page, between normal forms. Distributed connected components over
the edges are the sets of aliases. A block decision on any alias holds for all of its set; an explicit allow on any
alias takes precedence over it, for the whole set.

Rules are domains (each holds for itself and its subdomains) and URLs (compared in normal form), to block or to allow.
Rule tables are joined by equality: each host is expanded to its parent domains, so no rule is tried on every page.

Defined results: a null or empty URL has no normal form: its decision is 'none', and it has no aliases. Repeated URLs
are decided alike. All canonical links and refresh tags of a page's whole HTML count, but for those in comments and scripts;
relative ones are resolved against its URL or its base tag. Targets of other schemes than http and https are no links. Only the
named columns are read. The result has a row for each row of pages: (page_id, url, component, decision), the component being the least
normal form of the set, the decision 'allow', 'block' or 'none'.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import written

#: Rules of the registered query: (decision, kind, value); ``decide`` takes any table of them.
RULES = (
    ("block", "domain", "casino-win.example.com"), ("block", "domain", "free-bets.example.com"), ("block", "domain", "cheap-pills.example.com"),
    ("block", "domain", "ththth.example.net"), ("allow", "domain", "m.ththth.example.net"), ("allow", "domain", "blog.tionsh.example.com"),
)
#: Rules up to which their table is sent to every executor.
BROADCAST_ROWS = 500_000
#: What goes before an address is taken apart; what a host may have around it; ends of paths without a query; tracking parameters.
_BEFORE = ((r"#.*$", ""), (r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), (r"^//", ""))
_AROUND_HOST, _ENDS = ((r"^.*@", ""), (r":(80|443)?$", "")), ((r"(/index)?\.html?$", ""), (r"/+$", ""))
_TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid|sessionid)(=|$)"
_HOST, _PATH, _QUERY = r"^([^/?]*)", r"^[^/?]*([^?]*)", r"^[^?]*\?(.*)$"
#: www. and m. before a host of two labels or more.
_ALIAS = r"^(?:www|m)\.([^./?]+\.[^./?])"
#: Of the SQL alone, which reads the first link of each form; ``targets`` reads all.
_CANONICAL = (r"(?i)<link[^>]*rel=[\"']?canonical[\"']?[^>]*href=[\"']([^\"'>]*)", r"(?i)<link[^>]*href=[\"']([^\"'>]*)[\"'][^>]*rel=[\"']?canonical")
_REFRESH = r"(?i)<meta[^>]*http-equiv=[\"']?refresh[\"']?[^>]*url=[\"']?([^\"'>]*)"
#: What a page may have its links in, or hide them in; an attribute; a scheme; the time before a refresh tag's address.
_TAGS = re.compile(r"""<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<(link|meta|base)\b((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.I | re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SCHEME, _DELAY = re.compile(r"^([a-z][a-z0-9+.-]*:)?//", re.I), re.compile(r"\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?", re.I)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the variable of a lambda keeps the value's expression from being copied."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _replaced(c: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for a, b in steps:
        c = F.regexp_replace(c, a, b)
    return c


def bare(url: Column) -> Column:
    """Normal form but for www. and m., so that a rule can tell these hosts apart."""

    def form(u: Column) -> Column:
        host = F.lower(_replaced(F.regexp_extract(u, _HOST, 1), _AROUND_HOST))
        query = F.array_join(F.filter(F.split(F.regexp_extract(u, _QUERY, 1), "&"), lambda x: (x != "") & ~x.rlike(_TRACKING)), "&")
        path = F.regexp_extract(u, _PATH, 1)
        return _let(query, lambda q: F.nullif(F.concat(host, F.when(q == "", _replaced(path, _ENDS)).otherwise(F.concat(path, F.lit("?"), q))), F.lit("")))

    return _let(_replaced(F.trim(url), _BEFORE), form)


def normal(url: Column) -> Column:
    return F.regexp_replace(bare(url), _ALIAS, "$1")


def targets(url: str, html: str) -> list[str]:
    """The absolute addresses that a page names as its canonical or next one."""
    base, found = "http://" + _SCHEME.sub("", url.strip()), []
    named: str | None = None
    for tag in _TAGS.finditer(html):
        if not tag[1]:
            continue
        have: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(tag[2]):
            have.setdefault(name.lower(), entities.unescape("".join(values)).strip())
        kind = tag[1].lower()
        if kind == "base":
            named = named or have.get("href")
        elif kind == "link" and "canonical" in have.get("rel", "").lower().split():
            found.append(have.get("href", ""))
        elif kind == "meta" and have.get("http-equiv", "").lower() == "refresh":
            to = _DELAY.sub("", have.get("content", ""), count=1)
            found.append(to[1:].split(to[0])[0].strip() if to[:1] in ("'", '"') else to)
    out = []
    for to in found:
        try:
            whole = urljoin(urljoin(base, named) if named else base, to)
        except ValueError:  # not an address
            continue
        if to and re.match("https?://", whole, re.I):
            out.append(whole)
    return list(dict.fromkeys(out))


def links(pages: DataFrame) -> DataFrame:
    """(a, b): normal forms of each page and of what it names as its canonical or next address."""
    found = pages.select(F.col("url").alias("url"), F.col("html").alias("html")).where("url is not null and html is not null")
    # a literal test first, as most pages have neither tag
    lower = F.lower("html")
    found = found.where(lower.contains("canonical") | lower.contains("refresh"))

    def run(batches):
        for batch in batches:
            rows = [(u, to) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for to in targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["url", "to"])

    named = found.mapInArrow(run, "url string, to string")
    return named.select(normal(F.col("url")).alias("a"), normal(F.col("to")).alias("b"))


def decide(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, component, decision) of every page; rules: (decision, kind, value); redirects: (from_url, to_url)."""
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(normal(F.col("from_url")), normal(F.col("to_url"))))
    edges = written(edges.where("a is not null and b is not null and a <> b").distinct(), "links")
    found = components(edges, "a", "b")
    named = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url")).withColumn("bare", bare(F.col("url"))).withColumn("node", normal(F.col("url")))
    # every address that a rule may name: of pages, and of aliases known from links or redirects alone
    addresses = named.select("node", "bare").union(edges.select("a", "a")).union(edges.select("b", "b")).where("node is not null").distinct()
    host = F.split(F.regexp_extract("bare", _HOST, 1), "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(host)), lambda k: F.array_join(F.slice(host, k, F.size(host)), "."))
    keys = F.concat(F.transform(parents, lambda p: F.concat(F.lit("domain:"), p)), F.array(F.concat(F.lit("url:"), "node")))
    given = rules.where("decision in ('allow', 'block')").select("decision", F.when(F.col("kind") == "url", F.concat(F.lit("url:"), normal(F.col("value")))).otherwise(F.concat(F.lit("domain:"), F.lower("value"))).alias("key")).distinct()
    given = F.broadcast(given) if given.count() <= BROADCAST_ROWS else given
    hits = addresses.select("node", F.explode(keys).alias("key")).join(given, "key").select("node", "decision")
    hits = hits.join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), "decision")
    verdicts = hits.groupBy("component").agg(F.min("decision").alias("decision"))  # 'allow' sorts before 'block'
    placed = named.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return placed.join(verdicts, "component", "left").select("page_id", "url", "component", F.coalesce("decision", F.lit("none")).alias("decision"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "decision string, kind string, value string"))


#: Pages, redirects and rules of the query ``url_redirects``: (page_id, url, html), (from_url, to_url), (decision, kind, value).
FIXTURE_PAGES = tuple(
    (k, url, html)
    for c in range(12)
    for k, url, html in (
        (10 * c, f"http://www.site{c}.example/start/", f'<link rel="canonical" href="https://host{c}.example/a?utm_source=x&id={c}">'),
        (10 * c + 1, f"https://user@host{c}.example:443/a?id={c}", f'<meta http-equiv="refresh" content="0; url=/b">'),
        (10 * c + 2, f"host{c}.example/b/index.html#top", "no link"),
        (10 * c + 3, f"http://lone{c}.example/?page={c}", None),
        (10 * c + 4, None if c % 2 else "", f'<link href="http://host{c}.example/b" rel="canonical">'),
    )
)
FIXTURE_REDIRECTS = tuple((f"http://old{c}.example/{x}", f"http://{to}.example/{y}") for c in range(12) for x, to, y in (("1", f"old{c}", "2"), ("2", f"host{c}", "b"), ("1", f"old{c}", "2")))
FIXTURE_RULES = (
    *(("block", "domain", f"old{c}.example") for c in range(0, 12, 2)), *(("allow", "url", f"http://site{c}.example/start") for c in range(0, 12, 4)), ("block", "url", "http://lone5.example/?page=5"), ("block", "domain", "lone7.example"), ("allow", "domain", "nobody.example"),
)


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``decide`` over a fixture with redirects, chains of canonical links, and sets that are both allowed and blocked."""
    pages = spark.createDataFrame(FIXTURE_PAGES, "page_id long, url string, html string")
    return decide(pages, spark.createDataFrame(FIXTURE_RULES, "decision string, kind string, value string"), spark.createDataFrame(FIXTURE_REDIRECTS, "from_url string, to_url string"))


def redirects_sql() -> str:
    def values(rows) -> str:
        return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)

    pages = f"(SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM (VALUES {values(FIXTURE_PAGES)}) v(page_id, url, html))"
    return sql(pages, FIXTURE_RULES, f"(VALUES {values(FIXTURE_REDIRECTS)}) r(from_url, to_url)")


def sql(pages: str = "pages", rules: tuple[tuple[str, str, str], ...] = RULES, redirects: str | None = None) -> str:
    """DuckDB SQL of ``decide``, links of pages included."""

    def replaced(c: str, steps: tuple[tuple[str, str], ...]) -> str:
        for a, b in steps:
            c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
        return c

    def form(x: str) -> str:
        u = replaced(f"trim({x})", _BEFORE)
        host = f"lower({replaced(f"regexp_extract({u}, '{_HOST}', 1)", _AROUND_HOST)})"
        query = f"array_to_string(list_filter(string_split(regexp_extract({u}, '{_QUERY}', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACKING}')), '&')"
        path = f"regexp_extract({u}, '{_PATH}', 1)"
        return f"nullif({host} || CASE WHEN {query} = '' THEN {replaced(path, _ENDS)} ELSE {path} || '?' || {query} END, '')"

    def node(x: str) -> str:
        return f"regexp_replace({x}, '{_ALIAS}', '\\1')"

    def quoted(p: str) -> str:
        return p.replace("'", "''")

    table = ", ".join(f"('{d}', '{k}', '{quoted(v)}')" for d, k, v in rules)
    targets = ", ".join(f"regexp_extract(html, '{quoted(p)}', 1)" for p in (*_CANONICAL, _REFRESH))
    moved = f"UNION SELECT {node(form('from_url'))}, {node(form('to_url'))} FROM {redirects}" if redirects else ""
    return rf"""
WITH RECURSIVE named AS (SELECT page_id, url, html, {form('url')} AS bare FROM {pages}),
placed AS (SELECT *, {node('bare')} AS node FROM named),
targets AS (SELECT node AS a, regexp_extract(bare, '{_HOST}', 1) AS host, trim(unnest([{targets}])) AS t FROM placed WHERE html IS NOT NULL),
whole AS (SELECT a, CASE WHEN t LIKE '/%' AND t NOT LIKE '//%' THEN host || t ELSE t END AS t FROM targets WHERE t <> ''),
links AS (SELECT DISTINCT a, b FROM (SELECT a, {node(form('t'))} AS b FROM whole {moved}) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comps AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a),
addresses AS (SELECT DISTINCT node, bare FROM placed WHERE node IS NOT NULL UNION SELECT a, a FROM links UNION SELECT b, b FROM links),
hosts AS (SELECT node, string_split(regexp_extract(bare, '{_HOST}', 1), '.') AS h FROM addresses),
keys AS (SELECT node, 'domain:' || array_to_string(h[k:], '.') AS key FROM (SELECT node, h, unnest(range(1, len(h) + 1)) AS k FROM hosts) UNION SELECT node, 'url:' || node FROM addresses),
given(decision, kind, value) AS (VALUES {table}),
rules AS (SELECT decision, CASE kind WHEN 'url' THEN 'url:' || {node(form('value'))} ELSE 'domain:' || lower(value) END AS key FROM given),
verdicts AS (SELECT coalesce(component, k.node) AS component, min(decision) AS decision FROM keys k JOIN rules USING (key) LEFT JOIN comps c ON c.node = k.node GROUP BY 1)
SELECT page_id, url, coalesce(c.component, p.node) AS component, coalesce(v.decision, 'none') AS decision
FROM placed p LEFT JOIN comps c ON c.node = p.node LEFT JOIN verdicts v ON v.component = coalesce(c.component, p.node)
"""
