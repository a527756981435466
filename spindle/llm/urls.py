"""URL filters: rules for hosts and paths, and a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A strict term rejects alone, soft terms from SOFT_HITS distinct ones.
STRICT = ("adult", "casino", "cialis", "escort", "malware", "phishing", "porn", "porno", "viagra", "warez", "xxx")
SOFT = (
    "ads bet bets betting cheap click coupon crack dating farm free gambling jackpot keygen loan loans lottery nude payday "
    "pharmacy pill pills poker popup promo replica serial sex slots spam torrent track tracker win"
).split()
SOFT_HITS = 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A to Z lower-cased, and path; both empty if there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def vocabulary_hits(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """struct(strict, soft): how many distinct terms of each kind occur in the
    lower-cased url, with no letter or digit (a to z, 0 to 9) beside them."""
    terms = [(t, 0) for t in strict] + [(t, 1) for t in soft]

    def counted(urls: pd.Series) -> pd.DataFrame:
        finder = ahocorasick.Automaton()
        for term, kind in terms:
            finder.add_word(term, (len(term), kind, term))
        finder.make_automaton()
        bound = set("abcdefghijklmnopqrstuvwxyz0123456789")
        found = []
        for url in urls:
            seen = (set(), set())
            for end, (size, kind, term) in finder.iter(url) if url else ():
                start = end - size
                if (start < 0 or url[start] not in bound) and (end + 1 == len(url) or url[end + 1] not in bound):
                    seen[kind].add(term)
            found.append((len(seen[0]), len(seen[1])))
        return pd.DataFrame(found, columns=["strict", "soft"])

    return F.pandas_udf(counted, "strict int, soft int")(F.translate(url, UPPER, LOWER))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_terms, soft_terms), a row per
    row of `pages`.

    A rule is a verdict, `block` or `allow`, and a host followed by a path. It
    fits urls of the host and of all its subdomains whose path starts with the
    rule's; the longest that fits decides, the first in alphabetical order among
    equally long ones. Otherwise one strict or SOFT_HITS distinct soft terms
    block, and everything else is allowed. Urls without :// have an empty host
    and path, fit no rule and are judged by their terms; null urls have none.
    Repeated rows are judged alike, an empty table gives an empty result, and
    other columns are not looked at.

    The rules become one expression, so they should be few; the vocabulary is
    searched in one pass over each url.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    judged = rows.withColumns({"host": host, "path": path, "hits": vocabulary_hits(F.coalesce("url", F.lit("")))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        named, _, rest = text.partition("/")
        fits = ((F.col("host") == named) | F.col("host").endswith(f".{named}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    rejected = (F.col("hits.strict") >= 1) | (F.col("hits.soft") >= SOFT_HITS)
    own = F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("hits.strict").alias("strict_terms"), F.col("hits.soft").alias("soft_terms")
    )
