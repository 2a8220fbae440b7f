"""External links: domains and checks, status reports, rewriting rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.encodings import query_decode
from lorekeep.functions.titles import full_page_name, parse_titles
from lorekeep.functions.urls import host_suffixes, is_checkable, url_host, without_fragment
from lorekeep.operators.common import Time
from lorekeep.functions.times import as_timestamp
from lorekeep.sources.catalog import Catalog

# ---- URL checks ---------------------------------------------------------------------------


def distinct_urls(links: DataFrame) -> DataFrame:
    """Distinct external URLs, ordered."""
    return links.select("el_to").distinct().orderBy("el_to")


def checkable_urls(links: DataFrame) -> DataFrame:
    """``url, domain_name`` of distinct public URLs without fragment."""
    # the filter runs before the shuffle of distinct
    good = links.select("el_to").where(is_checkable(F.col("el_to")))
    return good.select(without_fragment(F.col("el_to")).alias("url")).distinct().select(
        "url", url_host(F.col("url")).alias("domain_name")
    )


def urls_to_check(checks: DataFrame, now: Time, max_age_days: int = 7) -> DataFrame:
    """URLs never checked, checked too long ago, or with a status that asks to retry."""
    oldest = as_timestamp(now) - F.expr(f"interval {int(max_age_days)} days")
    due = F.col("last_check").isNull() | (F.col("last_check") < oldest) | F.col("http_status").isin(406, 429)
    return checks.where(due)


# fixed values: answers that say nothing about the page, per host
IGNORED_STATUS = {"crates.io": [404]}


def classify_fetch(
    fetched: DataFrame, now: Time, ignored: dict[str, list[int]] | None = None
) -> DataFrame:
    """Result of landed fetches: ``OK``, ``bad``, ``needs user check``.

    Needs ``url, http_status, text_status, server, captcha, ssl_error, resolved,
    domain_check`` (last check of the domain). A domain that failed to resolve
    within the hour before ``now`` makes its URLs bad without looking at the rest.
    Without a status the error decides: unresolved domains, SSL errors and redirect
    loops are bad; a missing issuer certificate and other errors need a look.
    """
    ignored = IGNORED_STATUS if ignored is None else ignored
    status, host = F.col("http_status"), url_host(F.col("url"))
    special = F.lit(False)
    for name, codes in ignored.items():
        special = special | ((host == name) & status.isin(codes))
    dead = (F.col("domain_check") > as_timestamp(now) - F.expr("interval 1 hour")) & ~F.col("resolved")
    client = status.between(400, 499)
    cloud = (status == 403) & (F.lower("server") == "cloudflare")
    review = F.lit("needs user check")
    issuer = F.contains("ssl_error", F.lit("unable to get local issuer certificate"))
    broken = ~F.col("resolved") | (F.col("ssl_error").isNotNull() & ~issuer) | (
        F.col("text_status") == "too many redirects"
    )
    result = (
        F.when(dead, F.lit("bad"))
        .when(status.isNull() & broken, F.lit("bad"))
        .when(special, review)
        .when(status.between(200, 299), F.lit("OK"))
        .when(client & F.col("captcha"), review)
        .when(cloud | (status == 429), review)
        .when(client, F.lit("bad"))
        .otherwise(review)
    )
    note = (
        F.when(dead | special, F.col("text_status"))
        .when(client & F.col("captcha"), F.lit("CloudFlare CAPTCHA"))
        .when(client & cloud, F.lit("CloudFlare block"))
        .otherwise(F.col("text_status"))
    )
    return fetched.withColumn("result", result).withColumn("text_status", note)


def status_description(checks: DataFrame) -> Column:
    """Why a link counts as dead."""
    code = F.col("http_status").cast("string")
    return (
        F.when(~F.col("resolved"), F.lit("domain name not resolved"))
        .when(F.col("ssl_error").isNotNull(), F.lit("SSL error"))
        .when(F.col("http_status").isNull(), F.col("text_status"))
        .when(F.col("text_status").isNull(), code)
        .otherwise(F.concat(code, F.lit(" ("), F.col("text_status"), F.lit(")")))
    )


def dead_links(links: DataFrame, checks: DataFrame) -> DataFrame:
    """Page, URL and description of links whose last check was bad."""
    bad = checks.where("result = 'bad'").withColumn("description", status_description(checks))
    df = links.where(is_checkable(F.col("el_to"))).withColumn("url", without_fragment(F.col("el_to")))
    return df.join(bad.select("url", "description"), "url").select("el_from", "el_to", "description")


# ---- URL rewriting ------------------------------------------------------------------------

# Landed rule tables. ``host`` is a host or a parent domain, NULL for rules tried on every URL;
# ``pattern`` matches the whole URL and ``$1`` in ``replacement`` is its first group. Of the rules
# that match, the one with the smallest ``priority`` decides.
URL_RULES = "priority int, host string, pattern string, replacement string, lower boolean, summary string"
LINK_RULES = "priority int, host string, pattern string, label string, prefix string, replacement string"


def read_rules(spark: SparkSession, path: str, schema: str = URL_RULES) -> DataFrame:
    """Rules landed as JSON lines."""
    return spark.read.schema(schema).json(path)


GRAM = 4
# what most URLs begin with tells no rules apart
_COMMON_START = r"^\^?https?:(?://)?(?:www\.)?"
_BREAK = "\x00"


def required_literal(pattern: Column) -> Column:
    """The longest text that every match of a pattern contains, NULL if none is sure to be GRAM long.

    Groups, classes and optional characters count for nothing; patterns with alternatives or inline
    flags have no literal.
    """
    out = F.regexp_replace(pattern, r"\\\\", _BREAK)
    out = F.regexp_replace(out, r"\[(?:\\.|[^\]\\])*\]", _BREAK)
    for _ in range(4):  # groups from the inside out
        out = F.regexp_replace(out, r"(?<!\\)\((?:\\.|[^()\\])*\)", _BREAK)
    nested = out.rlike(r"(?<!\\)[()]")
    out = F.regexp_replace(out, r"\\[A-Za-z0-9]", _BREAK)
    # what may be missing, then what may come more than once
    out = F.regexp_replace(out, r"(?:\\.|[^\\])(?:[?*]|\{[^}]*\})[?+]?", _BREAK)
    out = F.regexp_replace(out, r"(?<!\\)\+", _BREAK)
    out = F.regexp_replace(out, r"(?<!\\)[.^$]", _BREAK)
    out = F.regexp_replace(F.regexp_replace(out, r"\\(.)", "$1"), _COMMON_START, _BREAK)
    pieces = F.split(out, _BREAK)
    longest = F.aggregate(pieces, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    unsure = nested | F.contains(pattern, F.lit("|")) | F.contains(pattern, F.lit("(?")) | F.contains(pattern, F.lit("\\Q"))
    return F.when(~unsure & (F.length(longest) >= GRAM), longest)


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))
    ))


def _with_rules(urls: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """Rows of ``urls`` with each rule that matches ``text``; ``_whole`` is the rule's whole-URL pattern.

    One equi join: a URL meets the rules of its host and of the parent domains, and those without a
    host of which it holds a piece of the text that a match must contain. Only rules that have
    neither, such as ``.*``, meet every URL.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    whole = F.concat(F.lit("^(?:"), "pattern", F.lit(")$"))
    literal = F.when(F.col("host").isNull(), required_literal(F.col("pattern")))
    # the end of a literal says more than its beginning
    key = F.coalesce(
        F.concat(F.lit("host "), F.lower("host")), F.concat(F.lit("text "), F.right("_literal", F.lit(GRAM))), F.lit("")
    )
    known = rules.withColumns({"_literal": literal, "_whole": whole}).withColumn("_key", key)
    keys = F.concat(
        F.array(F.lit("")), F.transform(host_suffixes(host), lambda x: F.concat(F.lit("host "), x)),
        F.transform(_grams(F.col(text)), lambda x: F.concat(F.lit("text "), x)),
    )
    met = urls.withColumn("_key", F.explode(F.array_distinct(keys))).join(known, "_key")
    held = F.col("_literal").isNull() | F.contains(F.col(text), F.col("_literal"))
    return met.where(F.when(held, F.rlike(text, F.col("_whole"))).otherwise(False)).drop("_literal")


def rewrite_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, new_url, summary`` of every distinct URL that a rule changes.

    A rule that yields the same URL ends the search without a change. Each distinct
    URL is tried once, whatever the number of links to it.
    """
    hits = _with_rules(urls.select("url").where("url is not null").distinct(), rules, "url")
    new = F.regexp_replace("url", F.col("_whole"), F.col("replacement"))
    new = F.when(F.col("lower"), F.lower(new)).otherwise(new)
    first = hits.groupBy("url").agg(F.min(F.struct("priority", new.alias("new_url"), "summary")).alias("_rule"))
    return first.select("url", "_rule.new_url", "_rule.summary").where("new_url <> url")


def replace_links(links: DataFrame, rules: DataFrame) -> DataFrame:
    """External links that a rule turns into other wikitext: the columns of ``links`` and ``replacement``.

    ``links`` has ``url, text, brackets`` (``text`` is NULL without a link text). The
    rule's ``label`` tells which link texts qualify: ``any``, ``none``, ``bare`` (no
    text and no brackets), or ``same``: what follows the pattern ``prefix``, with which
    the text must start, equals the first group of the decoded URL, without regard to case. ``{text}`` in a
    replacement is the link text.
    """
    key = ["url", "text", "brackets"]
    wanted = links.select(*key).distinct().withColumn("_plain", query_decode(F.col("url")))
    prefix = F.concat(F.lit("^(?:"), F.coalesce("prefix", F.lit("")), F.lit(")"))
    text = F.trim("text")
    same = F.rlike(text, prefix) & (
        F.lower(F.regexp_replace(text, prefix, F.lit(""))) == F.lower(F.expr("regexp_extract(_plain, _whole, 1)"))
    )
    fits = (
        F.when(F.col("label") == "any", F.col("text").isNotNull())
        .when(F.col("label") == "none", F.col("text").isNull())
        .when(F.col("label") == "bare", F.col("text").isNull() & ~F.col("brackets"))
        .when(F.col("label") == "same", same)
    )
    pieces = F.transform(
        F.split("replacement", r"\{text\}"), lambda piece: F.regexp_replace("_plain", F.col("_whole"), piece)
    )
    value = F.call_function("array_join", pieces, F.coalesce("text", F.lit("")))
    hits = _with_rules(wanted, rules, "_plain").where(fits)
    first = hits.groupBy(*key).agg(F.min(F.struct("priority", value.alias("replacement"))).alias("_rule"))
    found = first.select(*[F.col(x).alias("_" + x) for x in key], "_rule.replacement")
    on = [F.col(x).eqNullSafe(F.col("_" + x)) for x in key]
    return links.join(found, on).drop(*["_" + x for x in key])


def site_links(cat: Catalog, links: DataFrame, base: str) -> DataFrame:
    """External links to the wiki itself as wikilinks.

    ``links`` needs ``url`` and ``text``. Links to media, file and category pages
    get a leading colon, so that they stay links.
    """
    head = F.lit(base)
    path = F.substr("url", F.lit(len(base) + 1))
    own = links.where(F.startswith("url", head) & path.rlike(r"^[^\s?]+$")).withColumn("_name", path)
    parsed = parse_titles(own, "_name", cat["interwiki"], cat["namespace_name"]).where("title_error is null")
    colon = F.when(F.col("ns_id").isin(-2, 6, 14) & (F.col("iwprefix") == ""), F.lit(":")).otherwise("")
    anchor = F.when(F.col("sectionname") != "", F.concat(F.lit("#"), "sectionname")).otherwise("")
    target = F.concat(colon, full_page_name(F.col("iwprefix"), F.col("namespace"), F.col("pagename")), anchor)
    label = F.when(F.col("text").isNotNull(), F.concat(F.lit("|"), "text")).otherwise("")
    return parsed.select(*links.columns, F.concat(F.lit("[["), target, label, F.lit("]]")).alias("wikilink"))


def matching_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Most specific rule per host: ``host, rule``.

    ``rules`` has ``rule`` and ``with_subdomains``. Each distinct host is unfolded
    into its parent domains, which makes the lookup an equi join.
    """
    distinct = hosts.select("host").distinct()
    unfolded = distinct.select("host", F.posexplode(host_suffixes(F.col("host"))).alias("depth", "rule"))
    hits = unfolded.join(rules, "rule").where((F.col("depth") == 0) | F.col("with_subdomains"))
    return hits.groupBy("host").agg(F.min_by("rule", "depth").alias("rule"))


def upgrade_to_https(links: DataFrame, rules: DataFrame) -> DataFrame:
    """http links whose host is on the upgrade list: ``el_from, el_to, new_url``."""
    plain = links.where(F.startswith("el_to", F.lit("http://"))).withColumn("host", url_host(F.col("el_to")))
    plain = plain.where("host is not null")
    return plain.join(matching_rules(plain, rules), "host").select(
        "el_from", "el_to", F.concat(F.lit("https://"), F.substr("el_to", F.lit(len("http://") + 1))).alias("new_url")
    )


def strip_extra_brackets(text: Column) -> Column:
    """``[[http://x y]]`` to ``[http://x y]``."""
    return F.regexp_replace(text, r"\[(\[(?:https?|ftp)://[^\[\]]*\])\]", "$1")


def manual_page_url(prefix: str, name: Column, section: Column, package: Column, anchor: Column) -> Column:
    """Address of a manual page from template parameters; missing ones are NULL."""
    from lorekeep.functions.encodings import anchor_encode, url_encode

    blank = lambda x: F.coalesce(F.trim(x), F.lit(""))
    return F.concat(
        F.lit(prefix), F.when(blank(package) != "", F.concat(blank(package), F.lit("/"))).otherwise(""),
        url_encode(F.trim(name)), F.when(blank(section) != "", F.concat(F.lit("."), blank(section))).otherwise(""),
        F.when(blank(anchor) != "", F.concat(F.lit("#"), url_encode(anchor_encode(F.trim(anchor))))).otherwise(""),
    )
