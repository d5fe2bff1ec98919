"""URL filters: pattern rules behind an index of literal tokens.

Every rule is filed under the rarest of the literal tokens that a matching URL must hold; rarity is counted over all
URLs. A URL's own tokens fetch the few rules filed under them, and only those run their regular expression. The rule
list is a parameter of checked size that every task holds; URLs are judged where they are, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import table

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules are sent to every task: at most so many characters of patterns (about 1.5 million rules).
MOST_RULE_CHARS = 64_000_000


@dataclass(frozen=True)
class UrlRule:
    """pattern: a regular expression searched in host + path; tokens: literals one of which the index may use, each a
    whole run of [a-z0-9] in every URL that matches; rank: of two hits the higher wins, then the later rule."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()
    rank: int = 0


def host_path_rule(rule: str, verdict: str) -> UrlRule:
    """A rule like `example.com/en/`: that host and its subdomains, paths that start so. Longer rules win."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # The last token of a path may go on in the URL, unless a sign ends it; the host's tokens are whole.
    tokens = TOKEN.findall(host) + TOKEN.findall(path.lower() if re.search(r"[^A-Za-z0-9]\Z", path) else re.sub(r"[A-Za-z0-9]+\Z", "", path).lower())
    return UrlRule(rule, verdict, pattern, tuple(tokens), 1_000_000 + len(rule))


def host_word_rule(word: str, verdict: str = "block") -> UrlRule:
    """Hosts that have the word as a part between dots and hyphens."""
    return UrlRule(f"host word {word}", verdict, rf"\A(?:[^/]*[.-])?{re.escape(word)}(?:[.-]|/|\Z)", tuple(TOKEN.findall(word)))


#: Fixed values of the contract.
CONTRACT_RULES = (
    host_path_rule("com/", "allow"), host_path_rule("example.com/en/", "block"),
    host_path_rule("www.example.com/en/", "allow"), host_path_rule("net/es/", "block"), host_path_rule("net/fr/", "block"),
)
#: Default words of hosts that training data leaves out.
BLOCKED_HOST_WORDS = (
    "adult", "ads", "adserver", "bet", "bets", "casino", "clickbait", "escort", "gambling", "hentai", "jackpot", "malware", "phishing",
    "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "tracker", "track", "viagra", "warez", "xxx",
)
DEFAULT_RULES = tuple(host_word_rule(w) for w in BLOCKED_HOST_WORDS)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host = rest[: end.start()] if end else rest
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


class RuleIndex:
    def __init__(self, rules: tuple[UrlRule, ...], counts: dict[str, int]):
        """counts: in how many URLs each token is; a token that is not in it is the rarest."""
        self.rules, self.by_token, self.always = rules, {}, []
        for i, rule in enumerate(rules):
            if rule.tokens:
                token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(token, []).append(i)
            else:
                self.always.append(i)
        self.compiled: dict[int, re.Pattern] = {}

    def best(self, host: str, path: str) -> UrlRule | None:
        text = host + path
        found = [*self.always]
        for token in set(TOKEN.findall(text.lower())):
            found += self.by_token.get(token, ())
        hits = []
        for i in found:
            if i not in self.compiled:
                self.compiled[i] = re.compile(self.rules[i].pattern)
            if self.compiled[i].search(text):
                hits.append((self.rules[i].rank, i))
        return self.rules[max(hits)[1]] if hits else None


def token_counts(urls: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, int]:
    """In how many URLs each token of the rules is: one number per token, counted over all rows."""
    wanted = sorted({t for r in rules for t in r.tokens})
    known = urls.sparkSession.createDataFrame([(t,) for t in wanted], "_token string")
    tokens = F.array_distinct(F.split(F.lower(F.coalesce("_url", F.lit(""))), "[^a-z0-9]+"))
    seen = urls.select(F.explode(tokens).alias("_token")).join(F.broadcast(known), "_token").groupBy("_token").count()
    return {r["_token"]: r["count"] for r in seen.collect()}


def filter_urls(
    pages: DataFrame, rules: tuple[UrlRule, ...] = CONTRACT_RULES + DEFAULT_RULES, *, otherwise: str = "allow", id_col="page_id", url_col="url",
) -> DataFrame:
    """Per row: the id, host, path, hit (name of the winning rule, else NULL), verdict (its, else `otherwise`).

    NULL URLs and those without `://` have an empty host and path and are judged like any other. Repeated rows each get
    a row; other columns are not looked at; an empty table gives an empty result.
    """
    if sum(len(r.pattern) for r in rules) > MOST_RULE_CHARS:
        raise ValueError("the rule list is too large to be sent to every task; judge the URLs in several runs")
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    index = RuleIndex(tuple(rules), token_counts(urls, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, hits, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule = index.best(host, path)
                hosts.append(host)
                paths.append(path)
                hits.append(rule.name if rule else None)
                verdicts.append(rule.verdict if rule else otherwise)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.string()) for x in (hosts, paths, hits, verdicts)]], names=["_id", "host", "path", "hit", "verdict"],
            )

    id_type = urls.dtypes[0][1]
    out = urls.mapInArrow(run, f"_id {id_type}, host string, path string, hit string, verdict string")
    return out.withColumnRenamed("_id", id_col)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"))
    names = [r.name for r in CONTRACT_RULES]
    return out.select("page_id", "host", "path", F.when(F.col("hit").isin(names), F.col("hit")).alias("rule"), "verdict", "hit")


def _op1_sql() -> str:
    rules = sorted(CONTRACT_RULES, key=lambda r: -r.rank)
    fits = []
    for r in rules:
        host, _, path = r.name.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", r.name, r.verdict))
    rule = " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fits)
    words = ", ".join(f"'{w}'" for w in BLOCKED_HOST_WORDS)
    verdict = " ".join(f"WHEN '{n}' THEN '{v}'" for _, n, v in fits)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE {rule} END AS rule, list_sort(list_intersect(regexp_split_to_array(host, '[.-]'), [{words}]))[-1] AS word FROM parts
)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN word IS NULL THEN 'allow' ELSE 'block' END END AS verdict,
  coalesce(rule, 'host word ' || last_word) AS hit
FROM (SELECT *, list_filter([{words}], lambda w: list_contains(regexp_split_to_array(host, '[.-]'), w))[-1] AS last_word FROM ruled)
"""


OP1_SQL = _op1_sql()
