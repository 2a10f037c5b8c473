"""Operator 1, URL filters: rules are found by their rarest literal token, and only found rules run a regular expression."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, prepare

TOKEN = "[A-Za-z0-9]+"
#: Rules that one pass takes along to the executors; longer lists take several passes over the same rows.
BLOCK_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """`host/path` (kind "place") fits the host and its subdomains where the path starts with the rule's.

    Kind "pattern" is matched against the whole lower-cased url: `||` starts at the host or one of its
    labels, `|` is an end of the url, `^` a separator or the end, `*` anything.
    """

    text: str
    action: str
    kind: str = "place"

    def regex(self) -> str:
        if self.kind == "place":
            return r"(?:[^/]*\.)?" + re.escape(self.text)
        body, head, tail = self.text, ".*", ""
        if body.startswith("||"):
            body, head = body[2:], r"[^:/?#]*://(?:[^/?#]*\.)?"
        elif body.startswith("|"):
            body, head = body[1:], ""
        if body.endswith("|"):
            body, tail = body[:-1], r"\Z"
        parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}
        return "(?s:" + head + "".join(parts.get(c) or re.escape(c) for c in body) + tail + ")"

    def tokens(self) -> list[str]:
        """Literal tokens that a url which fits must have as whole tokens: those that nothing can lengthen."""
        text = self.text if self.kind == "place" else self.text.replace("||", "^").replace("|", "^")
        closed = self.kind == "place"
        found = []
        for m in re.finditer(TOKEN, text):
            left = (m.start() > 0 and text[m.start() - 1] != "*") or (m.start() == 0 and closed)
            right = m.end() < len(text) and text[m.end()] != "*"
            if left and right:
                found.append(m[0])
        return found


#: What op1 judges by, and patterns for urls that no place rule fits.
PLACES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)
PATTERNS = tuple(Rule(x, "block", "pattern") for x in ("||spam-farm.", "||cheap-pills.", "^casino^", "^viagra^", "^xxx^", "^porn^", "^torrent^", "^wp-login.php", "^phishing^"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, subjects: list[Column], tokens: set[str]) -> dict[str, int]:
    """In how many rows each token of a rule occurs. One number per rule token comes back."""
    if not tokens:
        return {}
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string"))
    lists = [F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)) for s in subjects]
    found = urls.select(F.explode(F.array_distinct(F.concat(*lists))).alias("token")).join(wanted, "token")
    return {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}


def index(rules: Iterable[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Rules by the rarest of their tokens; those without a token stand under None and are always tried."""
    out = defaultdict(list)
    for rule in rules:
        out[min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default=None)].append(rule)
    return dict(out)


def _judge(rules: list[Rule], counts: dict[str, int]):
    """A column function: the longest rule that fits, as (size, blocks, text); of equally long ones a block."""
    table = {k: [(r.text, r.action, r.regex()) for r in v] for k, v in index(rules, counts).items()}

    @F.pandas_udf("size int, blocks boolean, text string")
    def judge(subject: pd.Series) -> pd.DataFrame:
        found, match = re.compile(TOKEN).findall, re.compile
        always, rows = table.get(None, []), []
        compiled: dict[str, re.Pattern] = {}
        for s in subject:
            best = (-1, False, None)
            tried = [r for t in set(found(s)) & table.keys() for r in table[t]] if s else []
            for text, action, regex in [*always, *tried]:
                if (len(text), action == "block", text) > (best[0], best[1], best[2] or ""):
                    if regex not in compiled:
                        compiled[regex] = match(regex)
                    if compiled[regex].match(s):
                        best = (len(text), action == "block", text)
            rows.append(best)
        return pd.DataFrame(rows, columns=["size", "blocks", "text"])

    return judge


def _best(rules: list[Rule], counts: dict[str, int], subject: Column) -> Column:
    """The best of all blocks of rules. Each block is of bounded size, however long the list is."""
    none = F.struct(F.lit(-1).alias("size"), F.lit(False).alias("blocks"), F.lit(None).cast("string").alias("text"))
    found = [_judge(rules[a : a + BLOCK_RULES], counts)(subject) for a in range(0, len(rules), BLOCK_RULES)]
    return F.greatest(none, *found) if found else none


def judge_urls(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", places: Iterable[Rule] = PLACES, patterns: Iterable[Rule] = PATTERNS, default: str = "allow"
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, pattern.

    Of the place rules that fit, the longest decides. Where none fits, the longest pattern that fits does
    (`pattern` names it), else `default`. Rules are indexed by the token that the fewest urls of this table
    have, so a url runs the regular expressions of few rules, however many there are.

    A url that is null, empty or without `://` has an empty host and path, which no place rule fits. Ids may
    be null or repeat. Other columns play no part. Urls of any length are read in whole.
    """
    prepare(pages.sparkSession)
    places, patterns = list(places), list(patterns)
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(ascii_lower(F.col(url)), F.lit("")).alias("low"))
    place = F.concat("host", "path")
    wanted = {t for r in [*places, *patterns] for t in r.tokens()}
    counts = token_counts(rows, [place, F.col("low")], wanted)
    rows = rows.withColumn("place", _best(places, counts, place)).withColumn("fit", _best(patterns, counts, F.col("low")))
    word = lambda c: F.when(F.col(c)["blocks"], F.lit("block")).otherwise(F.lit("allow"))
    fits = F.col("place")["size"] >= 0
    verdict = F.when(fits, word("place")).when(F.col("fit")["size"] >= 0, word("fit")).otherwise(F.lit(default))
    return rows.select("page_id", "host", "path", F.col("place")["text"].alias("rule"), verdict.alias("verdict"), F.when(~fits, F.col("fit")["text"]).alias("pattern"))
