"""URL filters with redirect equivalence.

Rules name a host with a path prefix (``example.org/es/``) and allow or block. A rule
fits its host and all subdomains; the longest rule that fits a URL decides it. Pages
tie URLs together by redirects (``<meta http-equiv=refresh>``) and canonical links
(``<link rel=canonical>``); connected components over these edges are classes of
aliases. A block decision of any URL of a class holds for all of it, but a URL with a
rule of its own, an allow above all, keeps that rule's verdict.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpoint
from .simhash import components

Rules = list[tuple[str, str]]

#: What may hold an edge: comments and raw elements are passed over, tags are looked at.
_SEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|template|title)\b.*?(?:</\1\s*>|\Z)"
                   r"|<(link|meta|base)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTR = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_REFRESH = re.compile(r"\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?[\"']?([^\"']*)", re.I)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: ''."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits; a null struct if none does. Of rules
    of one length the one with the longer host decides, then the smaller rule. ``rules``:
    ('allow' or 'block', 'host/path prefix')."""
    seen: dict[str, str] = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {verdict!r} {rule!r}")
        if seen.setdefault(rule, verdict) != verdict:
            raise ValueError(f"the rule {rule!r} both allows and blocks")
    ordered = sorted(seen.items(), key=lambda r: (-len(r[0]), -r[0].index("/"), r[0]))
    fits = [F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix),
                   F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
            for rule, verdict in ordered for name, _, prefix in [rule.partition("/")]]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _targets(page: str, url: str) -> Iterator[str]:
    """Where the page's redirects and canonical links lead, as absolute URLs."""
    base = url
    for m in _SEEN.finditer(page):
        if not m[2]:
            continue
        attrs = {name.lower(): entities.unescape("".join(v)) for name, *v in reversed(_ATTR.findall(m[3]))}
        tag, to = m[2].lower(), None
        if tag == "base" and base == url and attrs.get("href"):
            base = _resolved(url, attrs["href"]) or url
        elif tag == "link" and "canonical" in attrs.get("rel", "").lower().split():
            to = attrs.get("href")
        elif tag == "meta" and attrs.get("http-equiv", "").strip().lower() == "refresh":
            found = _REFRESH.match(attrs.get("content", ""))
            to = found[1].strip() if found else None
        if to and (absolute := _resolved(base, to)):
            yield absolute


def _resolved(base: str, to: str) -> str | None:
    try:
        found = urljoin(base, to.strip())
    except ValueError:                                   # such as an unclosed bracket of an IPv6 host
        return None
    return found if "://" in found else None


def link_edges(df: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): the redirects and canonical links of the pages of ``df``, as absolute URLs.

    Only pages whose markup names either are parsed. A null url or html, a link without a
    target and a target that is no URL give no edge; repeated pages give repeated edges."""
    src = df.select(F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")) \
        .where("url IS NOT NULL AND html IS NOT NULL").where(F.col("html").rlike("(?i)canonical|refresh"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [(u, t) for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist()) for t in _targets(h, u)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], names=["src", "dst"])
    return arrow_map(src, run, "src string, dst string")


def _alias_key(url: Column) -> Column:
    """What makes two URLs one: all but the fragment, with scheme and host in lower case, as 128 bits."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(plain, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.substring(F.sha2(F.concat(_ascii_lower(head), F.substr(plain, F.length(head) + 1)), 256), 1, 32)


def blocked_aliases(edges: DataFrame, rules: Rules) -> DataFrame:
    """(key): the URLs of ``edges`` (src, dst) in a class with a URL that a rule blocks. A class is
    a connected component; redirects into a hot target are joined by large-star / small-star
    rounds, whose sums and splittable joins hold no class in one task."""
    whole = edges.where(F.col("src").contains("://") & F.col("dst").contains("://"))
    ends = checkpoint(whole.select(_alias_key(F.col("src")).alias("a"), _alias_key(F.col("dst")).alias("b"),
                                   F.col("src"), F.col("dst")).distinct())
    judged = ends.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("src").alias("url")),
                                           F.struct(F.col("b").alias("key"), F.col("dst").alias("url")))).alias("x")).select("x.*")
    blocked = judged.where(rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"] == "block") \
        .select("key").distinct()
    roots = checkpoint(components(ends.select("a", "b")))
    bad = roots.join(blocked, roots["node"] == blocked["key"]).select("root").distinct()
    inside = roots.join(bad, "root", "left_semi").select(F.col("node").alias("key"))
    return inside.unionByName(blocked).distinct()


def judge_urls(df: DataFrame, rules: Rules, *, edges: DataFrame | None = None, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``df``. ``edges`` (src, dst): the
    redirects and canonical links; None takes them from the pages' html.

    The verdict is the longest fitting rule's. Without one it is 'block' if the URL's class
    of aliases holds a URL that a rule blocks, else 'allow'. A null url, or one without
    ``://``, has an empty host and path, no rule, no aliases, and is allowed; repeated rows are
    judged each; an empty table gives no rows; other columns are ignored. Fragments do not tell
    URLs apart as aliases."""
    edges = link_edges(df, url_col=url_col, html_col=html_col) if edges is None else edges
    bad = checkpoint(blocked_aliases(edges, rules))
    url = F.col("url")
    rows = (df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
            .select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), _alias_key(url).alias("key"))
            .withColumn("own", rule_for(F.col("host"), F.col("path"), rules)))
    out = rows.join(bad.withColumn("hit", F.lit(True)), "key", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                      F.coalesce("own.verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"))
