"""Verdicts on URLs: host rules, then pattern rules found by their rarest literal token.

A pattern is text in which ``*`` stands for anything and ``^`` for one separator (anything but a letter, a digit or
one of ``_-.%``) or the end; ``|`` at its start or end ties it to that end of the URL.  Its literal
tokens are the runs of letters and digits that separators enclose, so they are whole tokens of every URL that
matches.  Each rule is filed under the one of its tokens that the fewest URLs hold, by a count over
all URLs; a URL looks up its own tokens and runs the regular expressions of the rules it finds, and no others.
Patterns match in any case.  Rules without such a token are tried on every URL.  Exceptions (allow) beat blocks; without a match the verdict is allow.

A host rule (host and path prefix) fits its host and all subdomains; the longest decides before any pattern.

Null URL, or one without ``://``, has an empty host and path, and is judged by patterns alone (null: none).
URLs of any length are judged whole, a final line feed included.  Rows that repeat are judged once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    text: str
    verdict: str

    @property
    def regex(self) -> str:
        """For lower-cased URLs, with the end as RE2 writes it."""
        return self._regex("$")

    def compiled(self) -> re.Pattern:
        """The same in Python, where ``$`` would also match before a final line feed."""
        return re.compile(self._regex(r"\Z"))

    def _regex(self, end: str) -> str:
        text = self.text.lower()
        parts = [rf"(?:[^a-z0-9_.%-]|{end})" if c == "^" else r"[\s\S]*" if c == "*" else re.escape(c) for c in text.strip("|")]
        return ("^" if text.startswith("|") else "") + "".join(parts) + (end if text.endswith("|") and len(text) > 1 else "")

    @property
    def tokens(self) -> list[str]:
        """Whole tokens of any URL that matches: a run must not touch ``*`` or a loose end of the pattern."""
        body = self.text.lower()
        found = []
        for m in re.finditer(r"[a-z0-9]+", body):
            before = body[m.start() - 1] if m.start() else "*"
            after = body[m.end()] if m.end() < len(body) else "*"
            if before != "*" and after != "*":
                found.append(m[0])
        return found


#: The host rules and patterns that the registered query applies.
HOST_RULES = [
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
]
PATTERNS = [
    Pattern("?utm_source=feed^", "block"),
    Pattern("&ref=*^", "block"),
    Pattern("/login^", "block"),
    Pattern("/signup^", "block"),
    Pattern("/wp-admin/", "block"),
    Pattern("/cart/*checkout", "block"),
    Pattern("^sessionid=", "block"),
    Pattern("://ads.*/", "block"),
    Pattern("/tag/*/feed/", "block"),
    Pattern(".exe|", "block"),
    Pattern(".zip|", "block"),
    Pattern("|javascript:", "block"),
    Pattern("://m.*/es/*?page=", "block"),
    Pattern("://blog.*/en/*?utm_source=feed^", "allow"),
    Pattern("/en/*.html|", "allow"),
]


def token_counts(urls: DataFrame, patterns: list[Pattern]) -> dict[str, int]:
    """URLs that hold each literal token of the rules; one row a token comes back."""
    wanted = sorted({t for p in patterns for t in p.tokens})
    if not wanted:
        return {}
    tokens = F.array_intersect(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, wanted)))
    return dict(urls.select(F.explode(tokens).alias("token")).groupBy("token").count().collect())


def rarest_token_index(patterns: list[Pattern], counts: dict[str, int]) -> dict[str | None, list[int]]:
    """Token -> numbers of the rules filed under it; None -> rules without a token."""
    index: dict[str | None, list[int]] = {}
    for i, pattern in enumerate(patterns):
        token = min(pattern.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
        index.setdefault(token, []).append(i)
    return index


def judge(pages: DataFrame, host_rules: list[HostRule], patterns: list[Pattern]) -> DataFrame:
    """page_id, host, path, rule, verdict and the pattern that decided, if one did."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    index = rarest_token_index(patterns, token_counts(rows, patterns))
    by_host: dict[str, list[HostRule]] = {}
    for rule in host_rules:
        by_host.setdefault(rule.host, []).append(rule)

    @F.pandas_udf("rule string, verdict string, pattern string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled = [p.compiled() for p in patterns]
        for url, host, path in batches:
            yield pd.DataFrame([judged_url(*parts, compiled) for parts in zip(url, host, path, strict=True)], columns=["rule", "verdict", "pattern"])

    def judged_url(url: str | None, host: str, path: str, compiled: list[re.Pattern]) -> tuple[str | None, str, str | None]:
        labels = host.split(".")
        fits = [r for i in range(len(labels)) for r in by_host.get(".".join(labels[i:]), ()) if path.startswith(r.path)] if host else []
        if fits:
            best = max(fits, key=lambda r: (len(r.name), r.name))
            return best.name, best.verdict, None
        url = (url or "").lower()
        found = {i for t in {None, *re.findall("[a-z0-9]+", url)} for i in index.get(t, ())}
        hits = [i for i in sorted(found) if compiled[i].search(url)]
        first = next((i for i in hits if patterns[i].verdict == "allow"), next(iter(hits), None))
        return (None, "allow", None) if first is None else (None, patterns[first].verdict, patterns[first].text)

    at = F.instr(F.coalesce("url", F.lit("")), "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise(F.lit(""))
    parts = rows.withColumn("rest", rest).select(
        "page_id", "url", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path")
    )
    judged = parts.withColumn("v", verdict(F.lower("url"), F.col("host"), F.col("path")))
    return judged.select("page_id", "host", "path", "v.rule", "v.verdict", "v.pattern")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def judge_sql(host_rules: list[HostRule], patterns: list[Pattern]) -> str:
    """The same verdicts in SQL, where every rule is tried on every URL."""
    hosts = ", ".join(f"({_text(r.host)}, {_text(r.path)}, {_text(r.verdict)})" for r in host_rules)
    rules = ", ".join(f"({i}, {_text(p.text)}, {_text(p.regex)}, {_text(p.verdict)})" for i, p in enumerate(patterns))
    return rf"""
WITH host_rules(rule_host, rule_path, verdict) AS (VALUES {hosts}), patterns(i, pattern, regex, verdict) AS (VALUES {rules}),
rests AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), fits AS (
  SELECT page_id, max_by(rule_host || rule_path, (length(rule_host || rule_path), rule_host || rule_path)) AS rule, max_by(verdict, (length(rule_host || rule_path), rule_host || rule_path)) AS verdict
  FROM parts JOIN host_rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
), hits AS (
  SELECT page_id, min_by(pattern, (verdict <> 'allow', i)) AS pattern, min_by(verdict, (verdict <> 'allow', i)) AS verdict
  FROM parts JOIN patterns ON regexp_matches(lower(coalesce(url, '')), regex) GROUP BY page_id
)
SELECT p.page_id, host, path, f.rule, CASE WHEN f.rule IS NOT NULL THEN f.verdict ELSE coalesce(h.verdict, 'allow') END AS verdict,
  CASE WHEN f.rule IS NULL THEN h.pattern END AS pattern
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id LEFT JOIN hits h ON h.page_id = p.page_id
"""
