"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule is (host, path, verdict): it fits its host and all subdomains where the url's path starts with
the rule's; the longest rule (host and path together) wins, ties go to the smaller rule text.

Keys: a host's labels reversed and joined by dots, then the path (a host has no slash, so the two never
mix). For each suffix of a url's host that has rules, the key of suffix and path is looked for among the
intervals that the rules' keys, as prefixes, span. Prefix intervals are nested or apart, so a sweep over
keys and rule starts in one order keeps a stack of nested rules: each rule carries its stack (itself and
the rules that are its prefixes), the last rule start before a key gives the stack there, and the
deepest entry that is still a prefix of the key is the longest rule of that suffix.

Skew. The sweep runs per rule host and salt: a host's urls are dealt over as many salts as its
count asks for, and its few rule starts are copied to each, so no host's urls meet in one task.

Defined results: a null url, or one without ``://``, has host and path empty and no rule; without
a rule the verdict is ``default``; equal rules count once, and of rules equal but for the verdict the
smallest verdict stands; a rule with a null or empty host fits nothing; rows repeat as they are, and a null
``page_id`` keeps its row; an empty table of pages gives no row, one of rules no rule anywhere; other columns
are kept, but for those that the result is called by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import save

ROWS_PER_SALT = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def suffixes(host: Column) -> Column:
    """A host and its parent domains, without empty ones."""
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.filter(F.array_distinct(every), lambda h: h != "")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(rule_host, key, stack): ``stack`` holds (key, rule, verdict) of the rule and of every rule of its host that
    is a prefix of it, shortest first. A stack is at most as deep as the rule is long."""
    one = (rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
           .where("host is not null and host != ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
           .select(F.col("host").alias("rule_host"), F.concat(reversed_host(F.col("host")), "path").alias("key"),
                   F.concat("host", "path").alias("rule"), "verdict", "path"))
    # a rule's prefixes meet the rules they are by an equi-join: no pair of rules is compared
    heads = one.select("rule_host", "key", F.explode(F.sequence(
        F.length("key") - F.length("path"), F.length("key"))).alias("n")) \
        .select("rule_host", "key", F.expr("substring(key, 1, n)").alias("head"))
    own = one.select("rule_host", F.col("key").alias("head"), "rule", "verdict")
    return (heads.join(own, ["rule_host", "head"])
            .groupBy("rule_host", "key")
            .agg(F.sort_array(F.collect_list(F.struct(F.length("head").alias("n"), F.col("head").alias("key"), "rule",
                                                      "verdict"))).alias("stack")))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict added."""
    names = ("host", "path", "rule", "verdict")
    url = F.col(f"`{url_col}`")
    rest = [c for c in pages.columns if c not in names]
    parsed = pages.select(*[F.col(f"`{c}`") for c in rest], host_of(url).alias("host"), path_of(url).alias("path"))
    stacks = save(rule_stacks(rules), "rule-stacks")
    # distinct (host, path) pairs are judged, so repeated urls are swept once
    seen = save(parsed.select("host", "path").where("host != ''").distinct(), "urls")
    level = seen.withColumn("rule_host", F.explode(suffixes(F.col("host"))))
    hosts = stacks.select("rule_host").distinct()
    # AQE broadcasts the rule hosts when they are few, else sorts both sides
    hit = level.join(hosts, "rule_host", "left_semi")
    salts = hit.groupBy("rule_host").agg(F.ceil(F.count("*") / ROWS_PER_SALT).cast("int").alias("salts"))
    keys = (hit.join(salts, "rule_host")
            .select("rule_host", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"),
                    F.concat(reversed_host(F.col("rule_host")), "path").alias("key"), "host", "path",
                    F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")))
    starts = (stacks.join(salts, "rule_host")
              .select("rule_host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key",
                      F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack"))
    # rule starts sort before equal keys: host is null there
    order = W.partitionBy("rule_host", "salt").orderBy("key", F.col("host").asc_nulls_first()) \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    top = F.last("stack", ignorenulls=True).over(order)
    swept = starts.unionByName(keys).withColumn("stack", top).where("host is not null and stack is not null")
    fits = swept.select("host", "path", F.try_element_at(
        F.filter("stack", lambda r: F.expr("key").startswith(r["key"])), F.lit(-1)).alias("best")).where("best is not null")
    won = fits.groupBy("host", "path").agg(F.min_by(
        "best", F.struct(-F.length("best.rule"), F.col("best.rule"))).alias("best"))
    won = won.select("host", "path", "best.rule", F.col("best.verdict").alias("verdict"))
    return (parsed.join(won, ["host", "path"], "left")
            .select(*[F.col(f"`{c}`") for c in rest], "host", "path", "rule",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))
