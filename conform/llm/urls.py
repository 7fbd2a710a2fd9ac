"""Block and allow lists for web addresses, extended to their redirect and canonical aliases.

Method: redirects and canonical links join addresses into classes (distributed connected components). A block decision of
any member holds for every alias that no rule speaks about; an explicit rule of an address itself always goes first, and a
class with a directly allowed member is not blocked through its aliases.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.llm.graph import components
from conform.session import stage

#: Rules up to this count are sent to every task; more are dealt out by host.
BROADCAST_RULES = 100_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """An address without scheme and fragment: what links speak about. Null without a host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]*)", 1)))


_TAG = re.compile(r"<(link|meta|base)(?=[\s/>])", re.I)
#: What a tag holds up to its end; a quoted value may hold ``>``.
_BODY = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(>?)")
_ATTRIBUTE = re.compile(r"[\s\"'/]([^\s\"'>/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_REFRESH = re.compile(r"[\s\d.]*[;,\s]\s*(?:url\s*=\s*)?(.+)", re.I | re.S)


def declared(html: str) -> tuple[str | None, list[str]]:
    """The first base address of a page (null without one), and the targets of its canonical links and refreshes.

    Tags are read once from left to right, in time that grows with the page; one that does not end hides the rest of the page.
    """
    base, targets, at = None, [], 0
    while tag := _TAG.search(html, at):
        body = _BODY.match(html, tag.end())
        if not body[1]:
            break
        at, own = body.end(), {}
        for m in _ATTRIBUTE.finditer(html, tag.end(), at):
            own.setdefault(m[1].lower(), next(v for v in m.groups()[1:] if v is not None).replace("&amp;", "&").strip())
        name = tag[1].lower()
        if name == "base" and base is None:
            base = own.get("href")
        elif name == "link" and "canonical" in own.get("rel", "").lower().split():
            targets.append(own.get("href"))
        elif name == "meta" and own.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(own.get("content", ""))):
            targets.append(m[1].strip("\"'").strip())
    return base, [t for t in targets if t]


def declared_links(html: Column) -> Column:
    """``base`` and ``to`` of each page, see ``declared``."""

    @F.arrow_udf("struct<base: string, to: array<string>>")
    def read(pages: pa.Array) -> pa.Array:
        found = [declared(p.as_py() or "") for p in pages]
        return pa.StructArray.from_arrays([pa.array([b for b, _ in found], pa.string()), pa.array([t for _, t in found], pa.list_(pa.string()))], ["base", "to"])

    return read(html)


def resolved(base: Column, target: Column) -> Column:
    """``target`` as an absolute address, read against ``base``; null where neither gives a host."""
    scheme, origin = F.regexp_extract(base, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(base, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    own, query = F.regexp_extract(target, r"(?s)\A([^?#]*)", 1), F.regexp_extract(target, r"(?s)\A[^?#]*(\?[^#]*)", 1)
    query = F.when((own == "") & (query == ""), F.regexp_extract(base, r"(?s)\A[^?#]*(\?[^#]*)", 1)).otherwise(query)
    folder = F.regexp_extract(path_of(base), r"(?s)\A(.*/)", 1)
    path = (F.when(own == "", path_of(base)).when(own.startswith("/"), own)
            .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own)))
    # what stands between slashes, with . and .. taken out; a last one of these leaves its slash
    parts = F.slice(F.split(path, "/", -1), 2, F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(
        x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    last = F.element_at(parts, -1)
    walked = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    local = F.concat(origin, F.when(path == "", "").otherwise(F.concat(F.lit("/"), F.array_join(walked, "/"))), query)
    return (F.when(F.regexp_like(target, F.lit(r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*:")), target)
            .when(origin == "", F.lit(None)).when(target.startswith("//"), F.concat(scheme, target)).otherwise(local))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (``a``, ``b``) from each page to its canonical addresses and to the targets of its refreshes.

    Targets are read against the first base address of the page that has one, else against the page's own. ``rel`` may hold
    several words. Targets without a host even so give no edge.
    """
    low = F.lower(html_col)
    rows = pages.filter(low.contains("canonical") | low.contains("refresh")).select(F.trim(F.col(url_col)).alias("url"), declared_links(F.col(html_col)).alias("found"))
    found = rows.select("url", F.col("found.base").alias("base"), F.explode("found.to").alias("to"))
    base = F.coalesce(F.when(F.col("base") != "", resolved(F.col("url"), F.col("base"))), F.col("url"))
    return (found.select("url", "to", base.alias("base")).select(key_of(F.col("url")).alias("a"), key_of(resolved(F.col("base"), F.col("to"))).alias("b"))
            .filter("a is not null and b is not null and a <> b"))


def match_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct (``key``, ``host``, ``path``): adds ``rule`` and ``rule_verdict``.

    A rule (``host``, ``path``, ``verdict``) fits its host and all subdomains if the path starts with the rule's. Of equally
    long rules for one place the allowing one wins.
    """
    own = rules.select(F.col("host").alias("_host"), F.coalesce("path", F.lit("")).alias("_path"), "verdict").filter("_host is not null")
    n = own.count()
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = keys.filter("host <> ''").select("key", "path", F.explode(suffixes).alias("_host"))
    fits = asked.join(F.broadcast(own) if n <= BROADCAST_RULES else own, "_host").filter(F.col("path").startswith(F.col("_path")))
    best = fits.groupBy("key").agg(F.max(F.struct(F.length("_host"), F.length("_path"), (F.col("verdict") == "allow").alias("allow"),
                                                  F.concat("_host", "_path").alias("rule"), F.col("verdict"))).alias("r"))
    return best.select("key", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every page: the id, ``host``, ``path``, ``rule`` (or null) and ``verdict`` (allow or block).

    ``links`` has address pairs (``a``, ``b``) as ``key_of`` gives them. The verdict is the longest fitting rule's, else that of
    the class of aliases: block if a member is blocked by a rule and none is allowed by one, else allow. Addresses are judged
    once per distinct key, so a page set with one host or one address is no hot group. Null url: empty host and path, no rule,
    allow. Repeated rows each give a row; empty tables give no rows; null link ends are left out. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), key_of(F.col(url_col)).alias("key"))
    ends = stage(links.select("a", "b").filter("a is not null and b is not null").distinct(), "links")
    linked = ends.select(F.explode(F.array("a", "b")).alias("key")).distinct().select(
        "key", F.regexp_extract("key", r"(?s)\A([^/?]*)", 1).alias("host"), F.regexp_extract("key", r"(?s)\A[^/?]*([^?]*)", 1).alias("path"))
    keys = stage(rows.filter("key is not null").select("key", "host", "path").unionByName(linked).distinct(), "keys")
    ruled = stage(match_rules(keys, rules), "ruled")
    members = stage(components(ends), "aliases").withColumnRenamed("node", "key")
    by_class = members.join(ruled, "key").groupBy("root").agg(
        F.max((F.col("rule_verdict") == "block").cast("int")).alias("_blocks"), F.max((F.col("rule_verdict") == "allow").cast("int")).alias("_allows"))
    passed = members.join(by_class, "root").filter("_blocks = 1 and _allows = 0").select("key", F.lit(True).alias("_passed"))
    told = stage(ruled.join(passed, "key", "full").select("key", "rule", F.coalesce("rule_verdict", F.when(F.col("_passed"), F.lit("block"))).alias("_verdict")), "told")
    return rows.join(told, "key", "left").select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", F.lit("allow")).alias("verdict"))
