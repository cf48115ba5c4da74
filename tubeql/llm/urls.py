"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path + query together with tokens (runs of letters and digits) that any URL
it fits must have. Token frequencies are counted over all URLs, each rule is filed under its rarest token, the tokens
of a URL fetch the rules filed under them, and only those run their expressions. Up to MAX_MAP rules the index is a map
in the plan: each row fetches and tries its rules by itself, so nothing but the tokens' counts is shuffled. Beyond, the
tokens of all different URLs meet the index in a salted join.

Rules come from a table (host labels, path segments, query parameters by category, see CATEGORIES) or from the caller.

Defined results
* null url, or one with no "://": host and path are empty; no listed rule fits; verdict allow.
* a host keeps its port and user part; only A-Z are lower-cased; the path is as it stands.
* of the listed rules that fit, the longest (host and path together) decides; of equals the first by name.
* a URL that no listed rule fits is blocked if a pattern rule fits, and allowed otherwise.
* rows that repeat, and null page_ids, are judged as any row; an empty table gives an empty result; other columns
  are not looked at.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, skew_join

#: Rules that the plan carries as a map, at most.
MAX_MAP = 20_000
#: What lies between tokens.
GAPS = r"[^0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """listed: a rule that decides by length; the others only say block."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = True


def host_rule(action: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and the paths that begin with path."""
    whole = [x for x in re.split(GAPS, host) if x]
    inner = re.split(GAPS, path)
    whole += [x for x in inner[:-1] if x]  # the last may go on in the URL, unless it is empty
    return Rule(host + path, action, f"^([^/]*[.])?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(whole)))


def literal_tokens(word: str) -> tuple[str, ...]:
    return tuple(x for x in re.split(GAPS, word) if x)


def label_rule(word: str) -> Rule:
    """Blocks hosts with a label that has word as one of its hyphenated parts, in this order if there are several."""
    return Rule(f"label:{word}", "block", f"^([^/?]*[.-])?{re.escape(word)}([.:-][^/?]*)?([/?].*)?$", literal_tokens(word), False)


def segment_rule(word: str) -> Rule:
    """Blocks paths with this segment."""
    return Rule(f"segment:{word}", "block", f"^[^?]*/{re.escape(word)}([/?]|$)", literal_tokens(word), False)


def query_rule(word: str) -> Rule:
    """Blocks URLs with this query parameter."""
    return Rule(f"query:{word}", "block", f"[?&]{re.escape(word)}=", literal_tokens(word), False)


#: The rules of the contract, as (action, host, path).
LISTED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: What is blocked where no listed rule fits: (host labels, path segments, query parameters) by category.
CATEGORIES = {
    "gambling": (["casino", "bets", "betting", "poker", "jackpot", "slots", "roulette", "sportsbook"], ["casino", "betting"], []),
    "adult": (["adult", "xxx", "porn", "escort", "camgirls"], ["xxx", "porn"], []),
    "pharmacy": (["pills", "viagra", "cialis", "rx-online", "pharma-discount"], ["buy-pills"], []),
    "advertising": (["ads", "adserver", "ads-track", "doubleclick", "popunder", "click-bait", "clickbait"], ["adserver", "doorway", "popunder"], ["gclid", "adclick", "affid", "aff_id"]),
    "spam": (["spam", "spam-farm", "link-farm", "linkfarm", "seo-links", "doorway"], ["trackback"], []),
    "fraud": (["phishing", "payday-loans", "replica-watches", "fake-id", "free-money"], ["phishing"], []),
    "piracy": (["warez", "cracks", "keygen", "torrents"], ["warez", "keygen"], []),
    "machinery": ([], ["wp-login.php", "xmlrpc.php", "cgi-bin"], ["phpsessid", "jsessionid"]),
}
LABELS = [w for labels, _, _ in CATEGORIES.values() for w in labels]
SEGMENTS = list(dict.fromkeys(w for _, segments, _ in CATEGORIES.values() for w in segments))
PARAMETERS = [w for _, _, parameters in CATEGORIES.values() for w in parameters]


def default_rules() -> list[Rule]:
    return [*(host_rule(*x) for x in LISTED), *map(label_rule, LABELS), *map(segment_rule, SEGMENTS), *map(query_rule, PARAMETERS)]


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query(url: Column) -> Column:
    """From the first ? on, without the fragment."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*([?][^#]*)", 1), F.lit(""))


def tokens(subject: Column) -> Column:
    """The different tokens; the empty one, under which rules without tokens are filed, is always there."""
    return F.array_union(F.split(subject, GAPS), F.array(F.lit("")))


def rarest(subjects: DataFrame, rules: Sequence[Rule]) -> list[str]:
    """For each rule that of its tokens that the fewest subjects have, the first of equals; empty if it has none."""
    wanted = sorted({t for r in rules for t in r.tokens})
    n: dict[str, int] = {}
    if wanted:
        found = subjects.select(F.explode(F.array_intersect(tokens(F.col("subject")), F.lit(wanted))).alias("token"))
        n = dict(found.groupBy("token").agg(F.count("*").alias("n")).collect())  # one row a token of the rules
    return [min(r.tokens, key=lambda t: (n.get(t, 0), t), default="") for r in rules]


RULE = "struct<name:string,listed:boolean,action:string,pattern:string>"


def rows_of(rules: Sequence[Rule], keys: Sequence[str]) -> dict[str, list[dict]]:
    filed: dict[str, list[dict]] = defaultdict(list)
    for r, key in zip(rules, keys):
        filed[key].append({"name": r.name, "listed": r.listed, "action": r.action, "pattern": r.pattern})
    return filed


def rank(rule: Column) -> Column:
    """Orders listed rules: the longest first, then by name."""
    return F.struct((-F.length(rule["name"])).alias("n"), rule["name"].alias("name"), rule["action"].alias("action"))


def by_map(parts: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """parts with (best, hit): the deciding listed rule, and whether a pattern rule fits; all inside the row."""
    index = F.from_json(F.lit(json.dumps(rows_of(rules, keys))), f"map<string,array<{RULE}>>")
    wanted = F.array_intersect(tokens(F.col("subject")), F.lit(sorted(set(keys))))
    fetched = F.flatten(F.transform(wanted, lambda t: F.element_at(index, t)))
    fits = parts.withColumn("fits", F.filter(fetched, lambda r: F.regexp_like(F.col("subject"), r["pattern"])))
    best = F.array_min(F.transform(F.filter("fits", lambda r: r["listed"]), rank))
    return fits.withColumn("best", best).withColumn("hit", F.exists("fits", lambda r: ~r["listed"])).drop("fits")


def by_join(parts: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """As by_map, for any number of rules."""
    filed = parts.sparkSession.createDataFrame([(k, v) for k, v in rows_of(rules, keys).items()], f"token string, rules array<{RULE}>")
    subjects = parts.select("subject").distinct()
    fetched = skew_join(subjects.select("subject", F.explode(tokens(F.col("subject"))).alias("token")), filed, "token")
    fits = fetched.select("subject", F.explode("rules").alias("r")).where(F.regexp_like("subject", F.col("r.pattern")))
    found = checkpoint(fits.groupBy("subject").agg(F.min(F.when(F.col("r.listed"), rank(F.col("r")))).alias("best"), F.max(~F.col("r.listed")).alias("hit")))
    return skew_join(parts, found, "subject", "left")


def judge(pages: DataFrame, rules: Sequence[Rule] | None = None, most: int = MAX_MAP) -> DataFrame:
    """page_id, host, path, rule, verdict for each page."""
    rules = default_rules() if rules is None else list(rules)
    url = F.col("url")
    parts = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), F.concat(host(url), path(url), query(url)).alias("subject"))
    found = (by_map if len(rules) <= most else by_join)(parts, rules, rarest(parts, rules))
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("hit"), "block"), F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"))


def oracle(rules: Sequence[Rule] | None = None) -> str:
    """The same by trying every rule on every URL."""
    rules = default_rules() if rules is None else list(rules)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r.name)}, {str(r.listed).upper()}, {quote(r.action)}, {quote(r.pattern)})" for r in rules)
    return f"""
    WITH parts AS (
      SELECT page_id, row_number() OVER () AS n,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
        coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*([?][^#]*)', 1), '') AS query FROM pages),
    rules(name, listed, action, pattern) AS (VALUES {values}),
    fits AS (SELECT n, name, listed, action FROM parts, rules WHERE regexp_matches(host || path || query, pattern)),
    best AS (SELECT n, name, action FROM fits WHERE listed QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(name) DESC, name) = 1)
    SELECT page_id, host, path, best.name AS rule,
      coalesce(best.action, CASE WHEN parts.n IN (SELECT n FROM fits WHERE NOT listed) THEN 'block' END, 'allow') AS verdict
    FROM parts LEFT JOIN best USING (n)"""
