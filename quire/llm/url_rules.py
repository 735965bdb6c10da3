"""URL filters: pattern rules fetched by their rarest literal token.

A rule is a host suffix, a path prefix or a regular expression over the
normalised url (host lower-cased, then path). Its whole literal tokens are
known; the one that the fewest urls of the corpus contain becomes its index
key, from a count over all urls of just the tokens that rules mention. A rule
without a literal token is filed under the empty token, which every url has. A
url's tokens look rules up by that key, and only the rules fetched run their
expression. Of the site rules that fit, the one of the highest rank (the
longest) decides; failing that, the method's own patterns; failing those, the
url is allowed. Rules of equal rank go by name.

Built from DataFrame functions alone. Up to ``LITERAL_RULES`` rules the index
is a literal map, so a url is judged where it is read, without a shuffle. More
rules are a table that joins by token, with the same result; a token that very
many urls have is the hot key of that join, which adaptive execution splits.

Defined cases: null urls and urls without ``://`` have empty host and path and
no rule, unless a rule without a token fits; a rule table's null or empty
``tokens`` mean that it has none; repeated rows are judged each; an empty table
gives an empty result, an empty rule set allows all; unnamed columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import beside, counted, materialise

LITERAL_RULES = 10_000

_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name``: what is reported; ``pattern``: Java regular expression, matched from the start of host + path;
    ``tokens``: literal tokens that every url it matches contains whole; ``rank``: the highest that fits wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def prefix_rule(verdict: str, text: str) -> Rule:
    """A ``host/path`` rule: the host with its subdomains and a path prefix."""
    host, slash, path = text.partition("/")
    # the last token of the path may go on in a url, so only tokens closed by a delimiter count
    closed = _TOKEN.findall(re.sub("[a-z0-9]+$", "", slash + path.lower()))
    return Rule(text, verdict, rf"^(?:[^/]*\.)?\Q{host}\E\Q{slash}{path}\E", (*_TOKEN.findall(host.lower()), *closed), len(text))


def host_pattern(verdict: str, words: str) -> Rule:
    """A host with ``words`` (hyphenated tokens) standing between delimiters."""
    return Rule(words, verdict, rf"^(?:[^/]*[^a-z0-9/])?\Q{words}\E(?![a-z0-9])[^/]*(?:/|$)", tuple(_TOKEN.findall(words)), len(words))


#: The rules to apply, longest fit wins.
SITE_RULES = (
    prefix_rule("allow", "org/"),
    prefix_rule("block", "example.org/es/"),
    prefix_rule("block", "example.org/en/1"),
    prefix_rule("allow", "com/fr/"),
    prefix_rule("block", "com/de/"),
)

def path_pattern(verdict: str, words: str) -> Rule:
    """A path with ``words`` as a whole segment, or as one up to its extension."""
    return Rule(f"/{words}", verdict, rf"^[^/]*/(?:[^/]*/)*\Q{words}\E(?:[/.;]|\z)", tuple(_TOKEN.findall(words)), len(words))


def extension_pattern(verdict: str, extension: str) -> Rule:
    """A path that ends in ``.extension``."""
    return Rule(f".{extension}", verdict, rf"(?s)^[^/]*/.*\.(?i:\Q{extension}\E)\z", (extension,), len(extension))


#: Hosts of kinds that no corpus wants, by the words in their names.
SPAM_HOSTS = tuple(
    host_pattern("block", w)
    for words in (
        "adult adult-dating adult-x camgirls escort-service free-porn hardcore hentai milf nude-cams porn porno pornhub sex-cams sexcam webcam-sex xnxx xvideos xxx xxx-videos",
        "baccarat betting-odds bingo-online blackjack casino casinos free-bets free-spins jackpot online-casino poker-online roulette slot-machines slots-online sportsbet sportsbook",
        "buy-cialis buy-viagra canadian-pharmacy cheap-meds cheap-pills cialis levitra no-prescription online-pharmacy pharmacy-online tramadol viagra weight-loss-pills",
        "cash-advance easy-loans instant-loans payday-loan payday-loans quick-loans",
        "buy-followers buy-likes cheap-backlinks essay-writing-service fake-id fake-watches link-farm replica-bags replica-watches seo-backlinks spam spam-farm traffic-exchange",
        "ads-track adserver adservice adtrack adtracker click-track clicktracker doubleclick pixel-track popads popunder trackads",
        "crack-download cracked-apks free-cracks keygen malware nulled phishing serial-keys torrent-download warez",
        "crypto-doubler double-your-bitcoin free-bitcoin get-rich-quick",
    )
    for w in words.split()
)
#: Paths that lead to no page of text, and files that are none.
NO_PAGES = (
    *(path_pattern("block", w) for w in "add-to-cart autodiscover cart checkout cgi-bin login logout password-reset signin signup wp-admin wp-login xmlrpc".split()),
    *(extension_pattern("block", w) for w in "7z apk avi bin bz2 css dmg exe flac gif gz ico iso jar jpeg jpg js m4a m4v mkv mov mp3 mp4 msi png rar svg tar tgz tif ttf wav webm webp woff woff2 xz zip".split()),
)
#: The method's own verdict where no site rule fits.
PATTERNS = (*SPAM_HOSTS, *NO_PAGES)


_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _tokens(host: Column, path: Column) -> Column:
    """The literal tokens of a url, and the empty one that every url has."""
    return F.array_union(F.array(F.lit("")), F.split(F.lower(F.concat(host, path)), "[^a-z0-9]+"))


_OWN = ("host", "path", "rule", "verdict", "pattern")


def _parsed(pages: DataFrame, key: str, url_col: str) -> DataFrame:
    return pages.select(F.col(key).alias("_key"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))


def _index(parsed: DataFrame, rules: Sequence[tuple[int, Rule]]) -> Column:
    """Map from a rule's rarest token to the rules (with their tiers) filed under it."""
    wanted = sorted({t for _, r in rules for t in r.tokens})
    counts = dict.fromkeys(wanted, 0)
    if wanted:
        seen = parsed.select(F.explode(F.array_intersect(_tokens(F.col("_host"), F.col("_path")), F.array(*map(F.lit, wanted)))).alias("t"))
        counts |= {r["t"]: r["count"] for r in seen.groupBy("t").count().collect()}
    filed: dict[str, list[tuple[int, Rule]]] = {}
    for tier, r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (counts[t], t), default=""), []).append((tier, r))
    entry = lambda tier, r: F.struct(F.lit(tier).alias("tier"), F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
    return F.create_map(*[x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*[entry(*r) for r in rs]))])


def judge_urls(pages: DataFrame, key: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = SITE_RULES, patterns: Sequence[Rule] = PATTERNS) -> DataFrame:
    """key, host, path, rule (of ``rules``, else null), verdict and ``pattern`` (of ``patterns``, else null).

    A key column of such a name is returned as ``<name>_in``.
    """
    tiers = [(1, r) for r in rules] + [(0, r) for r in patterns]
    if len(tiers) > LITERAL_RULES:
        rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank, tier) for tier, r in tiers]
        table = pages.sparkSession.createDataFrame(rows, "name string, verdict string, pattern string, tokens array<string>, rank int, tier int")
        return judge_by_table(pages, table, key, url_col)
    parsed = _parsed(pages, key, url_col)
    if not tiers:
        none = F.lit(None).cast("string")
        return parsed.select(F.col("_key").alias(beside(key, _OWN)), F.col("_host").alias("host"), F.col("_path").alias("path"), none.alias("rule"), F.lit("allow").alias("verdict"), none.alias("pattern"))
    index = _index(parsed, tiers)
    fetched = F.flatten(F.filter(F.transform(_tokens(F.col("_host"), F.col("_path")), lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()))
    fits = F.filter(fetched, lambda r: F.regexp_like(F.concat("_host", "_path"), r["pattern"]))
    best = lambda tier: F.array_max(F.filter("_fits", lambda r: r["tier"] == tier))
    found = parsed.select("*", fits.alias("_fits")).select("_key", "_host", "_path", best(1).alias("_rule"), best(0).alias("_pattern"))
    return _verdicts(found, key)


def _verdicts(found: DataFrame, key: str) -> DataFrame:
    return found.select(F.col("_key").alias(beside(key, _OWN)), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.name").alias("rule"), F.coalesce("_rule.verdict", "_pattern.verdict", F.lit("allow")).alias("verdict"), F.col("_pattern.name").alias("pattern"))


def judge_by_table(pages: DataFrame, rules: DataFrame, key: str = "page_id", url_col: str = "url") -> DataFrame:
    """The same for a rule table of any size.

    ``rules`` has name (unique), verdict, pattern, tokens and rank, as ``Rule``
    does, and may have ``tier``: 1 for site rules (taken where the column is
    missing), 0 for patterns that decide where no site rule fits. Each rule is
    filed under its rarest token, so common tokens fetch few rules; matches come
    back by a key that is unique once the urls are written.
    """
    parsed = materialise(_parsed(pages, key, url_col).select(F.monotonically_increasing_id().alias("uid"), "*"), "urls")
    words = parsed.select("uid", F.concat("_host", "_path").alias("_text"), F.explode(_tokens(F.col("_host"), F.col("_path"))).alias("t"))
    tier = F.coalesce(F.col("tier"), F.lit(1)).cast("int") if "tier" in rules.columns else F.lit(1)
    rules = rules.select("name", "verdict", "pattern", "rank", tier.alias("tier"), "tokens")
    named = rules.select("name", F.explode_outer("tokens").alias("t")).select("name", F.coalesce("t", F.lit("")).alias("t"))
    seen = words.join(named.where("t <> ''").select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    filed = named.join(seen, "t", "left").groupBy("name").agg(F.min_by("t", F.struct((F.col("t") == "").alias("none"), F.coalesce("n", F.lit(0)), "t")).alias("t"))
    table = counted(filed.join(rules.drop("tokens"), "name"), "rules", LITERAL_RULES)
    entry = F.struct("tier", "rank", "name", "verdict")
    best = [F.max(F.when(F.col("tier") == k, entry)).alias(c) for k, c in ((1, "_rule"), (0, "_pattern"))]
    fits = words.join(table, "t").where(F.regexp_like("_text", F.col("pattern"))).groupBy("uid").agg(*best)
    return _verdicts(parsed.join(fits, "uid", "left"), key)


def op4_url_filters(spark, sf_dir):
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.name}')" for r in SITE_RULES)
    spam = ", ".join(f"('{r.name}')" for r in SPAM_HOSTS)
    none = ", ".join(f"('{r.name}')" for r in NO_PAGES)
    return rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath, rule) AS (VALUES {rules}),
s(word) AS (VALUES {spam}), q(word) AS (VALUES {none}),
fit AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p, r
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n),
bad AS (SELECT n, word, length(word) AS rank FROM p, s WHERE regexp_matches(host, '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')
  UNION ALL SELECT n, word, length(word) - 1 FROM p, q WHERE word[1] = '.' AND ends_with(lower(path), word)
  UNION ALL SELECT n, word, length(word) - 1 FROM p, q WHERE word[1] = '/' AND regexp_matches(path, word || '([/.;]|$)')),
spam AS (SELECT n, max_by(word, (rank, word)) AS word FROM bad GROUP BY n)
SELECT p.page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, word AS pattern
FROM p LEFT JOIN fit USING (n) LEFT JOIN spam USING (n)
"""


ORACLE_SQL = _oracle()
