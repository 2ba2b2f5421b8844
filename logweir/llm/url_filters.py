"""URL filters that follow redirects: a block holds for all addresses of a page."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.errors import ValidationError
from logweir.llm.components import components
from logweir.llm.tables import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules become one expression; longer lists belong in a table of their own.
MOST_RULES = 1000


class Rule(NamedTuple):
    """A verdict for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def parse_rule(text: str) -> Rule:
    """``"block example.org/es/"`` as a rule."""
    verdict, _, place = text.strip().partition(" ")
    host, slash, path = place.strip().partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValidationError(f"not a URL rule: {text!r}")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), "/" + path)


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """Host, path and query: what names a resource, whatever the scheme and fragment."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    whole = F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query)
    return F.when(host_of(url) != "", whole)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValidationError(f"at most {MOST_RULES} rules")
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(order):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        named = F.struct(
            F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict")
        )
        found = F.when(fits, named).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """The quoted or bare value of an attribute of a tag."""
    found = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(found, r"""^["']|["']$""", ""))


def alias_links(pages: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between the addresses of pages and those they redirect or defer to.

    Taken from the canonical links and refresh redirects of ``html``. A target is absolute,
    or begins with ``//`` or ``/``; any other is taken from the folder of the page's path.
    """
    html, url = F.col("html"), F.col("url")
    link = F.expr(r"""regexp_extract_all(html, '(?is)(<link\\b[^>]*>)', 1)""")
    meta = F.expr(r"""regexp_extract_all(html, '(?is)(<meta\\b[^>]*>)', 1)""")
    tagged = pages.where(
        html.rlike(r"(?i)canonical|http-equiv") & (host_of(url) != "")
    ).select(
        url,
        F.explode(
            F.concat(
                F.transform(
                    F.filter(link, lambda t: t.rlike(r"""(?is)[\s"']rel\s*=\s*["']?[^"'>]*\bcanonical\b""")),
                    lambda t: _attribute(t, "href"),
                ),
                F.transform(
                    F.filter(meta, lambda t: t.rlike(r"""(?is)http-equiv\s*=\s*["']?\s*refresh""")),
                    lambda t: F.trim(
                        F.regexp_extract(_attribute(t, "content"), r"""(?is)url\s*=\s*["']?([^"']*)""", 1)
                    ),
                ),
            )
        ).alias("target"),
    ).where("target <> ''")
    target = F.col("target")
    base = F.concat(F.lit("x://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    full = (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), target))
    )
    return tagged.select(address_of(url).alias("a"), address_of(full).alias("b")).where(
        "a is not null and b is not null and a <> b"
    ).distinct()


def url_verdicts(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of each row of ``pages``.

    Reads ``page_id``, ``url`` and ``html``; other columns may have any name. The longest
    rule that fits a url decides it. A page without a rule follows its aliases: addresses
    linked by redirects and canonical links, however far, are one component. If a rule allows
    one of them the page is allowed, else if a rule blocks one it is blocked, else allowed.
    The targets of links count, whether or not they are pages here.

    A url that is null or has no ``://`` has neither host, path, rule nor aliases and is
    allowed; null html links to nothing; repeated rows are judged each. Components are found
    on the links only, distributed; all other pages meet them in one join by address.
    """
    scratch = Scratch("url-aliases")
    links = scratch.write(alias_links(pages))
    grouped = components(links, scratch)
    # An address is judged as a url of its own.
    judged = grouped.withColumn("as_url", F.concat(F.lit("x://"), F.col("node")))
    judged = judged.withColumn(
        "verdict", rule_of(host_of(F.col("as_url")), path_of(F.col("as_url")), rules)["verdict"]
    )
    decided = judged.groupBy("component").agg(
        F.when(F.max(F.col("verdict") == "allow"), "allow")
        .when(F.max(F.col("verdict") == "block"), "block")
        .otherwise("allow")
        .alias("shared")
    )
    known = grouped.join(decided, "component").select(F.col("node").alias("address"), "shared")
    known = scratch.write(known)
    rows = pages.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        address_of(F.col("url")).alias("address"),
    ).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    scratch.drop(links)
    return rows.join(known, "address", "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "shared", F.lit("allow")).alias("verdict"),
    )
