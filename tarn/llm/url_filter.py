"""URL filters: site rules by longest match, then pattern rules found through their rarest literal token.

Everything is a column expression: a row is judged where it is read, without a shuffle, so hot hosts do no harm. The
rules travel in the plan; the only statistic taken from the corpus is how many URLs hold each literal of a rule.

Pattern rules are written with ``*`` (anything), ``^`` (a separator or the end), a leading ``||`` (start of a host or of
one of its labels), a leading or trailing ``|`` (start or end of the URL); ``@@`` in front makes a rule an exception.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path); the longest that fits wins.
SITE_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
PATTERN_RULES = (
    "?utm_source=", "&utm_source=", "?ref=*&utm_", "/ads/", "/adserver^", "||ads.", "||tracker.", "/track/*.gif", "?sessionid=", "&sessionid=",
    "/wp-login.php", "/popup^", "/cart/checkout^", "?page=*&ref=x|", "@@/ads/policy^", "@@?utm_source=archive^",
)
MAX_RULES = 10_000  # of each kind; they are part of the plan
TOKEN = "[a-z0-9]+"
_SITE = "struct<size:int,rule:string,path:string,verdict:string>"


def pattern_regex(pattern: str) -> str:
    """The regular expression of a rule, in the syntax that Java and RE2 share."""
    body = pattern.removeprefix("@@").lower()
    start = end = ""
    if body.startswith("||"):
        start, body = r"^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    if body.endswith("|"):
        end, body = "$", body[:-1]
    said = {"*": ".*", "^": r"([^a-z0-9_.%\-]|$)"}
    return "(?s)" + start + "".join(said.get(c) or (c if c.isalnum() or c in "/_=&:,;~" else f"\\{c}") for c in body) + end


def literal_tokens(pattern: str) -> list[str]:
    """The tokens that every URL matching the pattern has as whole tokens."""
    body = pattern.removeprefix("@@").lower()
    bounded = body.startswith("|"), body.endswith("|")
    body = body.strip("|")
    return [m[0] for m in re.finditer(TOKEN, body)
            if (body[m.start() - 1] != "*" if m.start() else bounded[0]) and (body[m.end()] != "*" if m.end() < len(body) else bounded[1])]


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(F.coalesce(url, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)))


def _map_of(entries: dict[str, list[Column]], kind: str) -> Column:
    if not entries:
        return F.create_map().cast(f"map<string,array<{kind}>>")
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.array(*v))]).cast(f"map<string,array<{kind}>>")


def _found(index: Column, keys: Column, kind: str) -> Column:
    """The entries of all keys."""
    return F.flatten(F.transform(keys, lambda k: F.coalesce(index[k], F.array().cast(f"array<{kind}>"))))


def token_counts(pages: DataFrame, tokens: list[str], url_col: str = "url") -> dict[str, int]:
    """In how many URLs each token occurs: one small row per token."""
    if not tokens:
        return {}
    words = pages.select(F.explode(_tokens(F.col(f"`{url_col}`"))).alias("token")).filter(F.col("token").isin(tokens))
    return {r.token: r.n for r in words.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(pages: DataFrame, url_col: str = "url", sites=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict (which replace columns of these names).

    A site rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins, of equally
    long ones the greater by code points. Without one (``rule`` null), a URL is blocked if a pattern rule matches it and no
    exception does, else allowed. A null or empty URL, or one without ``://``, has an empty host and path and fits no
    site rule; a null URL is allowed. Every row is judged by itself: repeated rows and an empty table need no care.
    A pattern without a token of its own is tried on every URL.
    """
    if max(len(sites), len(patterns)) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    seen = token_counts(pages, sorted({t for p in patterns for t in literal_tokens(p)}), url_col)
    by_token: dict[str, list[Column]] = {}
    always: list[Column] = []
    for p in patterns:
        entry = F.struct(F.lit(pattern_regex(p)).alias("regex"), F.lit(p.startswith("@@")).alias("exception"))
        rarest = min(literal_tokens(p), key=lambda t: (seen.get(t, 0), t), default=None)
        (always if rarest is None else by_token.setdefault(rarest, [])).append(entry)
    by_host: dict[str, list[Column]] = {}
    for action, host, path in sites:
        by_host.setdefault(host, []).append(F.struct(
            F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(path).alias("path"), F.lit(action).alias("verdict")))

    url, kind = F.col(f"`{url_col}`"), "struct<regex:string,exception:boolean>"
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(_found(_map_of(by_host, _SITE), suffixes, _SITE), lambda r: F.col("path").startswith(r["path"]))
    rows = pages.withColumns({
        "host": host_of(url), "path": path_of(url), "lower_": _lower(F.coalesce(url, F.lit(""))), "tokens_": _tokens(url)})
    tries = F.concat(_found(_map_of(by_token, kind), F.col("tokens_"), kind), F.array(*always).cast(f"array<{kind}>"))
    hits = F.filter(tries, lambda r: F.call_function("rlike", F.col("lower_"), r["regex"]))
    method = F.when(F.exists("hits_", lambda r: ~r["exception"]) & ~F.exists("hits_", lambda r: r["exception"]), "block").otherwise("allow")
    best = F.array_max(fitting)
    return (rows.withColumns({"best_": best, "hits_": hits})
            .withColumns({"rule": F.col("best_.rule"), "verdict": F.coalesce(F.col("best_.verdict"), method)})
            .drop("best_", "hits_", "lower_", "tokens_"))


def judge_sql(table: str = "pages", sites=SITE_RULES, patterns=PATTERN_RULES) -> str:
    """The same verdicts in DuckDB SQL, by trying every rule on every URL."""
    quoted = lambda s: s.replace("'", "''")
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(sites, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    pick = lambda of: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{of(a, h, p)}'" for a, h, p in ordered) + " END"
    any_of = lambda some: "(" + (" OR ".join(f"regexp_matches(low, '{quoted(pattern_regex(p))}')" for p in some) or "false") + ")"
    exceptions, blocks = [p for p in patterns if p.startswith("@@")], [p for p in patterns if not p.startswith("@@")]
    return f"""WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM {table})
SELECT page_id, host, path, {pick(lambda a, h, p: h + p)} AS rule,
  coalesce({pick(lambda a, h, p: a)}, CASE WHEN {any_of(blocks)} AND NOT {any_of(exceptions)} THEN 'block' ELSE 'allow' END) AS verdict FROM u"""
