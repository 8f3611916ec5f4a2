"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host and path together with literal tokens that every URL it fits must hold.
The rule is filed under the token that is rarest among the tokens of the URLs at hand. The tokens of a URL fetch the
rules filed under them, and only those run their expression. All of it is one row-local expression over a constant
index, so no URL moves and a host with a third of all rows costs nothing extra.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 20_000
_RULE = "struct<token:string,rule:string,verdict:string,pattern:string,weight:int,base:boolean>"


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in host + '\\n' + path; `tokens` are lower-case ASCII letter-digit runs that stand in every URL it fits."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    base: bool = False


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and all subdomains whose path starts with `path`; longer rules weigh more."""
    words = re.findall(r"[a-z0-9]+", host)
    words += [w.lower() for w in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return Rule(host + path, verdict, r"^(?:[^\n]*\.)?" + _quoted(host) + r"\n" + _quoted(path), tuple(words), len(host) + len(path), True)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/ ])", r"\\\1", text)


# fixed values: the list rules, and word rules for hosts and paths that no list rule fits
BASE_RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
WORD_RULES = (
    Rule("cheap-goods", "block", r"(?:^|[.-])cheap-(?:pills|meds|loans)(?:[.-]|\n)", ("cheap",), 1),
    Rule("betting", "block", r"(?i)(?:^|[^A-Za-z0-9])(?:casino|jackpot)(?:[^A-Za-z0-9]|$)", (), 1),
    Rule("adult", "block", r"(?i)(?:^|[^A-Za-z0-9])xxx(?:[^A-Za-z0-9]|$)", ("xxx",), 1),
    Rule("session", "block", r"\n.*/(?:login|signin|logout)(?:/|\.|$)", (), 1),
)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    """Distinct letter-digit runs, lower-cased."""
    return F.array_distinct(F.split(F.lower(text), r"[^a-z0-9]+"))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many rows each of the given tokens stands; as many numbers as there are tokens."""
    if not tokens:
        return {}
    row = urls.agg(*[F.coalesce(F.sum(F.array_contains("_tokens", t).cast("bigint")), F.lit(0)).alias(f"c{i}") for i, t in enumerate(tokens)]).first()
    return dict(zip(tokens, row, strict=True))


def rule_index(rules: list[Rule], counts: dict[str, int]) -> list[dict]:
    """Rules with the token they are filed under: the rarest, ties by name; '' for rules without a token."""
    if len(rules) > MAX_RULES:
        raise ValueError("more than %d rules" % MAX_RULES)
    out = []
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else ""
        out.append({"token": token, "rule": r.name, "verdict": r.verdict, "pattern": r.pattern, "weight": r.weight, "base": r.base})
    return out


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + WORD_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row, and `word_rule`, the word rule that decided, else null.

    The longest list rule that fits gives rule and verdict. Else the first word rule by name does, and else
    the default. A null url, or one without '://', has empty host and path.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    own = pages.select("page_id", url.alias("_url"))
    own = own.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    own = own.withColumn("_tokens", tokens_of(F.concat_ws("\n", "host", "path")))
    index = rule_index(list(rules), token_counts(own, sorted({t for r in rules for t in r.tokens})))
    buckets = 1 << max(0, (2 * len(index) - 1).bit_length())
    filed: list[list[dict]] = [[] for _ in range(buckets)]
    spark = pages.sparkSession
    places = spark.createDataFrame([(i, r["token"]) for i, r in enumerate(index)], "i int, t string").select("i", F.pmod(F.xxhash64("t"), F.lit(buckets)).alias("b")).collect()
    for i, b in places:
        filed[b].append(index[i])
    constant = F.from_json(F.lit(json.dumps(filed)), f"array<array<{_RULE}>>")
    asked = F.array_union(F.col("_tokens"), F.array(F.lit("")))
    fetched = F.flatten(F.transform(asked, lambda t: F.filter(F.element_at(constant, (F.pmod(F.xxhash64(t), F.lit(buckets)) + 1).cast("int")), lambda r: r["token"] == t)))
    found = own.select("page_id", "host", "path", F.explode(F.array(F.struct(F.concat_ws("\n", "host", "path").alias("text"), fetched.alias("rules")))).alias("_f"))
    fits = F.filter(F.col("_f.rules"), lambda r: F.rlike(F.col("_f.text"), r["pattern"]))
    best = F.array_max(F.transform(F.filter(fits, lambda r: r["base"]), lambda r: F.struct(r["weight"].alias("w"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    word = F.array_min(F.transform(F.filter(fits, lambda r: ~r["base"]), lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    judged = found.select("page_id", "host", "path", F.explode(F.array(F.struct(best.alias("list"), word.alias("word")))).alias("_j"))
    return judged.select(
        "page_id", "host", "path",
        F.col("_j.list.rule").alias("rule"),
        F.coalesce("_j.list.verdict", "_j.word.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("_j.list").isNull(), F.col("_j.word.rule")).alias("word_rule"),
    )


JUDGE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, pre, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
w(name, verdict, host_pattern, path_pattern) AS (VALUES
  ('adult', 'block', '(?i)(^|[^A-Za-z0-9])xxx([^A-Za-z0-9]|$)', '(?i)(^|[^A-Za-z0-9])xxx([^A-Za-z0-9]|$)'),
  ('betting', 'block', '(?i)(^|[^A-Za-z0-9])(casino|jackpot)([^A-Za-z0-9]|$)', '(?i)(^|[^A-Za-z0-9])(casino|jackpot)([^A-Za-z0-9]|$)'),
  ('cheap-goods', 'block', '(^|[.-])cheap-(pills|meds|loans)([.-]|$)', '[.-]cheap-(pills|meds|loans)[.-]'),
  ('session', 'block', 'a^', '/(login|signin|logout)(/|\.|$)')),
l AS (
  SELECT p.page_id, p.host, p.path, max_by(r.h || r.pre, length(r.h) + length(r.pre)) AS rule, max_by(r.verdict, length(r.h) + length(r.pre)) AS verdict
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre) GROUP BY ALL),
m AS (
  SELECT l.page_id, l.host, l.path, min(w.name) AS word_rule FROM l JOIN w ON regexp_matches(l.host, w.host_pattern) OR regexp_matches(l.path, w.path_pattern)
  WHERE l.rule IS NULL GROUP BY ALL)
SELECT l.page_id, l.host, l.path, l.rule, coalesce(l.verdict, CASE WHEN m.word_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict, m.word_rule
FROM l LEFT JOIN m ON l.page_id = m.page_id AND l.host = m.host AND l.path = m.path
"""
