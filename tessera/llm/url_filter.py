"""URL filter: pattern rules indexed by their rarest literal token; only the rules a URL's tokens fetch run their regex."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
#: Host rules, (verdict, rule): fixed values of the contract.
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The method's own pattern rules for URLs without a host rule: `*` any run, `^` a separator or the end, `||` a host start.
PATTERN_RULES = ("||casino*^", "-pills.", "||ads-track.", "||*.ads-track.", "/porn/", "||adult-", "-casino.", "||*.casino-")
#: Up to so many rules (a few MB) the rule index is broadcast; above, both sides are shuffled by token.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # as reported
    regex: str  # on "host" + path, both as parsed
    tokens: tuple[str, ...]  # literal tokens every match contains, `x*` being one that begins with x
    host_rule: bool


def host_rule(verdict: str, text: str) -> Rule:
    """Fits the host and its subdomains when the path starts with the rule's."""
    host, _, path = text.partition("/")
    tokens = set(re.findall(TOKEN, host)) | {t for t in re.findall(r"/([a-z0-9]+)(?=/)", "/" + path)}
    return Rule(verdict, text, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}", tuple(sorted(tokens)), True)


def pattern_rule(text: str) -> Rule:
    """An ad-block style pattern; its complete literal tokens are those between separators on both sides, and where it has
    none, what stands between a separator and a `*` begins a token."""
    body, start = (text[2:], r"^(?:[^/]*\.)?") if text.startswith("||") else (text, "")
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
    rx = start + "".join(parts.get(c, re.escape(c)) for c in body)
    bounded = ("|" if text.startswith("||") else "*") + body + "*"
    tokens = {m.group(1) for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", bounded)}
    begun = {m.group(1) + "*" for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=\*)", bounded)}
    return Rule("block", text, rx, tuple(sorted(tokens or begun)), False)


RULES = (*[host_rule(*r) for r in HOST_RULES], *[pattern_rule(r) for r in PATTERN_RULES])


def parse(url):
    """(host, path) columns: the host after the first `://` with A-Z lower-cased, then the path up to `?` or `#`."""
    from_ascii, to_ascii = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), from_ascii, to_ascii)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"(?s)^[^?#]*", 0)
    return host, path


def _begun(words, size: int):
    """``x*`` for the first letters of every word that has so many."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: F.concat(F.left(w, F.lit(size)), F.lit("*")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    The longest host rule that fits decides; else any pattern rule blocks, else allow. Null URLs and those without `://`
    have an empty host and path and are allowed. A rule is indexed under that of its tokens, or beginnings of tokens, which the
    fewest URLs have (counted over all URLs); a rule without any literal is tried on every URL. URLs are judged once each
    however often they repeat; rows are joined back by the URL's parts, so repeated ids and rows all stay. An empty table gives no
    rows; other columns are passed over.
    """
    spark = pages.sparkSession
    host, path = parse(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    whole = F.concat("host", "path")
    words = F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit(TOKEN), F.lit(0)))
    wanted = sorted({t for r in rules for t in r.tokens})
    sizes = sorted({len(t) - 1 for t in wanted if t.endswith("*")})
    words = F.array_distinct(F.concat(words, *[_begun(words, n) for n in sizes]))
    # URLs without host and path fit no rule; they are many rows of one key, so they stay out of the join.
    bare = (F.col("host") == "") & (F.col("path") == "")
    urls = rows.where(~bare).select("host", "path").distinct().select("host", "path", whole.alias("whole"), words.alias("words"))
    few = len(rules) <= BROADCAST_RULES
    vocabulary = spark.createDataFrame([(t,) for t in wanted], "token string")
    seen = urls.select(F.explode("words").alias("token")).join(F.broadcast(vocabulary) if few else vocabulary, "token")
    # One row a token of a rule at most: the rules are a driver-side argument, so is their vocabulary.
    count = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index = rule_index(spark, rules, count)
    if few:
        index = F.broadcast(index)
    fetched = urls.select("host", "path", "whole", F.explode(F.concat("words", F.array(F.lit("")))).alias("token")).join(index, "token")
    fits = fetched.where(F.expr("whole rlike regex"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("host_rule", "size", "text", "rule_verdict")).alias("best"))
    out = rows.where(~bare).join(best.withColumnsRenamed({"host": "_h", "path": "_p"}), (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    rule = F.when(F.col("best.host_rule"), F.col("best.text"))
    out = out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"))
    none = F.lit(None).cast("string").alias("rule")
    return out.unionByName(rows.where(bare).select("page_id", "host", "path", none, F.lit("allow").alias("verdict")))


def rule_index(spark: SparkSession, rules: tuple[Rule, ...], count: dict[str, int]) -> DataFrame:
    rows = []
    for r in rules:
        token = min(r.tokens, key=lambda t: (count.get(t, 0), t)) if r.tokens else ""
        rows.append((token, r.regex, r.text, len(r.text), r.verdict, r.host_rule))
    return spark.createDataFrame(rows, "token string, regex string, text string, size int, rule_verdict string, host_rule boolean")
