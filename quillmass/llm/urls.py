"""URL filters (operator 2), DataFrame functions only.

Every rule is a regular expression with the literal tokens that any fitting URL must hold. A rule is indexed
under its rarest token (fewest rules hold it; of these the longest); a URL's tokens fetch candidate rules, and
only candidates run their expression. The index is a hash table in the plan: an array of buckets, each with its
tokens, rules and expressions, so a token costs one place of an array. Sets of over ``MAX_INLINE`` rules are joined
on the token instead. Rules are a parameter and bounded by ``MAX_RULES``.

Very long URLs are judged whole; of equal rules the first decides. An empty table gives no rows. Null URLs and URLs without ``://`` have empty host and path, fit no rule and are allowed. Rows are judged one by
one, so repeated rows, null ids and extra columns do not matter.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000
#: Up to here the index is a literal in the plan (some 100 bytes a rule); larger sets are joined.
MAX_INLINE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALWAYS = ""


@dataclass(frozen=True)
class HostRule:
    """Fits a host, its subdomains, and paths that begin with the rule's: ``example.org/en/``."""

    verdict: str
    rule: str

    @property
    def expression(self) -> str:
        host, _, path = self.rule.partition("/")
        return r"(?s)^(?:[^/]*\.)?" + quoted(host + "/" + path)

    @property
    def tokens(self) -> list[str]:
        # the last path token may go on in the URL
        return re.findall(r"(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])", self.rule.lower())


@dataclass(frozen=True)
class PatternRule:
    """Fits where the pattern occurs in host and path; ``*`` stands for anything."""

    verdict: str
    rule: str

    @property
    def expression(self) -> str:
        # each part at its first place behind the one before, without trying others: linear in the URL
        parts = [quoted(p) for p in self.rule.split("*")]
        return "(?s)" + (parts[0] if len(parts) == 1 else "^" + "".join(f"(?>.*?{p})" for p in parts))

    @property
    def tokens(self) -> list[str]:
        # tokens that separators bound on both sides within the pattern
        return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", self.rule.lower())


def quoted(literal: str) -> str:
    """The literal as a regular expression that Java and RE2 read alike."""
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", literal)


@dataclass(frozen=True)
class RuleSet:
    """Host rules, of which the longest wins, before pattern rules, of which an allowing one wins."""

    hosts: tuple[HostRule, ...]
    patterns: tuple[PatternRule, ...]

    def ordered(self) -> list:
        """Rules by number: host rules, shorter ones first (of equals the later in the list), then patterns."""
        ranked = sorted(reversed(self.hosts), key=lambda r: len(r.rule))
        rules = [*ranked, *self.patterns]
        if len(rules) > MAX_RULES:
            raise ValueError(f"over {MAX_RULES} rules")
        return rules

    def index(self) -> dict[str, list[int]]:
        """Rule numbers by their rarest literal token; rules without a token stand under the empty one."""
        rules = self.ordered()
        held = Counter(t for r in rules for t in set(r.tokens))
        out: dict[str, list[int]] = {}
        for number, rule in enumerate(rules):
            rarest = min(rule.tokens, key=lambda t: (held[t], -len(t), t), default=ALWAYS)
            out.setdefault(rarest, []).append(number)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.translate(F.regexp_extract(url, found, 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(url, found, 2), F.lit(""))


def url_tokens(subject: Column) -> Column:
    """The distinct tokens of host and path, and the empty token for rules without one."""
    return F.array_distinct(F.concat(F.split(F.translate(subject, UPPER, LOWER), "[^a-z0-9]+"), F.array(F.lit(ALWAYS))))


def _fits_inline(subject: Column, rules: list, index: dict) -> Column:
    """The numbers of the rules that fit: a token's bucket, its entries of that token, and of these the expressions that match."""
    if not rules:
        return F.array().cast("array<int>")
    size = 1 << max(1, (2 * len(index) - 1).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for token, numbers in index.items():
        buckets[zlib.crc32(token.encode()) % size] += [{"t": token, "n": n, "e": rules[n].expression} for n in numbers]
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<t:string,n:int,e:string>>>")

    def fetched(token: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(token.cast("binary")), F.lit(size)).cast("int"))
        return F.transform(F.filter(bucket, lambda r: (r["t"] == token) & F.rlike(subject, r["e"])), lambda r: r["n"])

    return F.flatten(F.transform(url_tokens(subject), fetched))


def _fits_joined(pages: DataFrame, rules: list, index: dict) -> DataFrame:
    """The rows of ``pages`` (with _subject) and _fits, by a join of distinct subjects' tokens with the index."""
    spark = pages.sparkSession
    rows = [(token, n, rules[n].expression) for token, numbers in index.items() for n in numbers]
    entries = spark.createDataFrame(rows, "_token string, _rule int, _expression string")
    tokens = pages.select("_subject").distinct().select("_subject", F.explode(url_tokens(F.col("_subject"))).alias("_token"))
    fetched = tokens.join(entries, "_token").filter(F.rlike("_subject", F.col("_expression")))
    fits = fetched.groupBy("_subject").agg(F.collect_set("_rule").alias("_fits"))  # at most one number for each rule
    return pages.join(fits, "_subject", "left").withColumn("_fits", F.coalesce("_fits", F.array().cast("array<int>")))


def judge(pages: DataFrame, rules: RuleSet, url: str = "url", keep: tuple[str, ...] = ("page_id",), inline: bool | None = None) -> DataFrame:
    """``keep``, host, path, rule, verdict and method_rule (the pattern that decided) for every row."""
    ordered, index = rules.ordered(), rules.index()
    host, path = host_and_path(F.col(url))
    # a name of each kept column is free of the work columns' underscore names
    work = pages.select(*[F.col(c) for c in keep], host.alias("host"), path.alias("path")).withColumn("_subject", F.concat("host", "path"))
    if inline if inline is not None else len(ordered) <= MAX_INLINE:
        work = work.withColumn("_fits", _fits_inline(F.col("_subject"), ordered, index))
    else:
        work = _fits_joined(work, ordered, index)
    n_hosts = len(rules.hosts)
    names = F.from_json(F.lit(json.dumps([r.rule for r in ordered])), "array<string>")
    verdicts = F.from_json(F.lit(json.dumps([r.verdict for r in ordered])), "array<string>")
    best = F.array_max(F.filter("_fits", lambda n: n < n_hosts))
    patterns = F.filter("_fits", lambda n: n >= n_hosts)
    allowing = F.array_min(F.filter(patterns, lambda n: F.element_at(verdicts, n + 1) == "allow"))
    work = work.withColumn("_best", best).withColumn("_pattern", F.coalesce(allowing, F.array_min(patterns)))
    decided = F.coalesce(F.col("_best"), F.col("_pattern"))
    return work.select(
        *keep,
        "host",
        "path",
        F.when(F.col("_best").isNotNull(), F.element_at(names, F.col("_best") + 1)).alias("rule"),
        F.when(decided.isNotNull(), F.element_at(verdicts, decided + 1)).otherwise(F.lit("allow")).alias("verdict"),
        F.when(F.col("_pattern").isNotNull(), F.element_at(names, F.col("_pattern") + 1)).alias("method_rule"),
    )
