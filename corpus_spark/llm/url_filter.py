"""URL filters: host rules by longest fit, pattern rules behind a token index.

*Host rules* (verdict, host, path) fit a host and its subdomains when the path of the URL
starts with the rule's path; the longest rule wins. They are found by looking up the
ends of the host.

*Pattern rules* (verdict, pattern) decide what no host rule fits. In a pattern ``*`` is
any text, ``^`` a separator or the end, ``|`` the start or the end of the URL and ``||``
the start of a host or of its subdomain. The literals between separators are tokens that
every match must contain. Their frequency is counted over all URLs and each pattern is
filed under its rarest one; a URL's own tokens fetch its candidates, and only these run
as regular expressions. Patterns without a token are tried on every URL. A matching allow
pattern beats block patterns; without a match the URL is allowed.

Rows: a NULL URL or one without ``://`` has an empty host and path, which no host rule
fits; patterns see what text there is. An empty host has no ends. Repeated rows are judged
alike; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # verdict, host, path
Pattern = tuple[str, str]  # verdict, pattern

DEFAULT = "allow"
_TOKEN = re.compile(r"[a-z0-9_]+")
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _lower(text: str) -> str:
    return text.translate(_UPPER)


def parse_url(url: str | None) -> tuple[str, str]:
    """(host, path) as far as they are there."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return _lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def pattern_regex(pattern: str) -> str:
    """The regular expression of a pattern, for URLs in lower case."""
    body, start, end = _lower(pattern), "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^[a-z0-9+.-]+://([^/?#]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    kinds = {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}
    return start + "".join(kinds.get(c) or re.escape(c) for c in body) + end


def pattern_tokens(pattern: str) -> set[str]:
    """Tokens that every matching URL has: literals with a border on both sides."""
    body = _lower(pattern)
    found = set()
    for m in _TOKEN.finditer(body):
        before, after = body[: m.start()][-1:], body[m.end() :][:1]
        if before and before != "*" and after and after != "*":
            found.add(m[0])
    return found


def _token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(tokens.intersection(_TOKEN.findall(_lower(url or ""))))
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    rows = urls.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n"))
    return {r[0]: r[1] for r in rows.collect()}  # at most one row per token of the rules


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], patterns: Sequence[Pattern] = (), id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern); pattern is the one that decided, if one did."""
    urls = pages.select(F.col(id_col), F.col(url_col).cast("string").alias(url_col))
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(_lower(host), []).append((path, host + path, verdict))
    tokens = {p: pattern_tokens(p) for _, p in patterns}
    counts = _token_counts(urls.select(url_col), set().union(*tokens.values())) if patterns else {}
    index: dict[str, list[tuple[str, str, re.Pattern]]] = {}
    always = []
    for verdict, pattern in patterns:
        entry = (verdict, pattern, re.compile(pattern_regex(pattern)))
        rarest = min(tokens[pattern], key=lambda t: (counts.get(t, 0), t), default=None)
        (always if rarest is None else index.setdefault(rarest, [])).append(entry)

    def judge(url: str | None) -> tuple[str, str, str | None, str, str | None]:
        host, path = parse_url(url)
        labels = host.split(".") if host else []
        fitting = [
            rule
            for i in range(len(labels))
            for rule in by_host.get(".".join(labels[i:]), ())
            if path.startswith(rule[0])
        ]
        if fitting:
            _, name, verdict = max(fitting, key=lambda r: (len(r[1]), r[1], r[2]))
            return host, path, name, verdict, None
        text = _lower(url or "")
        candidates = [e for t in set(_TOKEN.findall(text)) for e in index.get(t, ())]
        hits = [(v, p) for v, p, regex in (*candidates, *always) if regex.search(text)]
        if not hits:
            return host, path, None, DEFAULT, None
        verdict = "allow" if any(v == "allow" for v, _ in hits) else "block"
        return host, path, None, verdict, min(p for v, p in hits if v == verdict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(judge, batch.column(1).to_pylist()))) or [[]] * 5
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], [id_col, *_OUT])

    kind = dict(urls.dtypes)[id_col]
    return urls.mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{c} string" for c in _OUT))


_OUT = ("host", "path", "rule", "verdict", "pattern")

# The rules of the registered query.
HOST_RULES: list[Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
PATTERN_RULES: list[Pattern] = [
    ("block", "^utm_source=*"),
    ("block", "^page=*&ref=*"),
    ("block", "||blog.*^en^"),
    ("block", "^es^*.html|"),
    ("allow", "||example.com^*#top|"),
    ("allow", "|https://m.*^fr^"),
]


def filter_sql(pages: str = "pages", rules: Sequence[Rule] = HOST_RULES, patterns: Sequence[Pattern] = PATTERN_RULES) -> str:
    """The same judgements with every rule and pattern tried on every URL."""
    lower = f"translate({{}}, '{''.join(map(chr, _UPPER))}', '{''.join(map(chr, _UPPER.values()))}')"
    fits = [
        f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}' END" for _, h, p in rules
    ]
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in rules)
    hits = {
        v: "list_filter(["
        + ", ".join(f"CASE WHEN regexp_matches(low, '{pattern_regex(p)}') THEN '{p}' END" for w, p in patterns if w == v)
        + "], lambda x: x IS NOT NULL)"
        for v in ("allow", "block")
    }
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, {lower.format("coalesce(url, '')")} AS low,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
split_ AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM parts),
named AS (
  SELECT page_id, low, {lower.format("raw_host")} AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM split_),
ruled AS (
  SELECT *, list_sort(list_transform(list_filter([{", ".join(fits)}], lambda x: x IS NOT NULL),
           lambda x: lpad(length(x)::VARCHAR, 6, '0') || x), 'DESC')[1] AS best,
         {hits["allow"]} AS allowed, {hits["block"]} AS blocked FROM named),
chosen AS (SELECT *, substr(best, 7) AS rule FROM ruled)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END
       WHEN len(allowed) > 0 THEN 'allow' WHEN len(blocked) > 0 THEN 'block' ELSE '{DEFAULT}' END AS verdict,
  CASE WHEN rule IS NULL THEN coalesce(list_min(allowed), list_min(blocked)) END AS pattern
FROM chosen"""
