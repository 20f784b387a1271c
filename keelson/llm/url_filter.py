"""URL filters: host rules by longest match, then a weighted vocabulary by Aho-Corasick.

One automaton holds strict and soft terms. An occurrence counts when the characters beside it
are not ASCII letters or digits. Each distinct term adds its weight once: a strict term weighs
as much as the threshold, a soft term 1; a url whose weights reach the threshold is rejected.
Empty lists of terms weigh nothing, empty terms are not terms, and a term of both lists is strict.

Rules: the host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
the path from there to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty
and is judged by the vocabulary on its whole text (null: empty, allowed). A host rule fits its
host and all subdomains when the path starts with the rule's; the longest rule wins over the
vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import lower_ascii, read

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: One of these rejects.
STRICT = ("adult", "casino", "escort", "hentai", "nude", "porn", "sex", "xxx")
#: Several distinct ones reject.
SOFT = ("bet", "bets", "bonus", "cheap", "click", "deal", "farm", "free", "jackpot", "loan", "loans", "pills",
        "poker", "prize", "slots", "spam", "win", "winner")
THRESHOLD = 2


def host_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")),
                  lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")),
                  F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


@lru_cache(maxsize=4)
def automaton(strict: tuple, soft: tuple, threshold: int):
    import ahocorasick

    a = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (threshold, strict)):
        for t in filter(None, terms):
            a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def weight_of(url: str, terms) -> int:
    """Summed weight of the distinct terms of a lower-cased url that stand between boundaries."""
    found: dict[str, int] = {}
    for end, (term, weight) in terms.iter(url) if len(terms) else ():
        a, b = end - len(term), end + 1
        if not (a >= 0 and url[a].isascii() and url[a].isalnum()) and \
                not (b < len(url) and url[b].isascii() and url[b].isalnum()):
            found[term] = weight
    return sum(found.values())


def vocabulary_weight(strict=STRICT, soft=SOFT, threshold: int = THRESHOLD):
    @F.pandas_udf("int")
    def weigh(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = automaton(strict, soft, threshold)
        for s in urls:
            yield pd.Series([weight_of(u, terms) for u in s], dtype="int32")
    return weigh


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT,
                soft=SOFT, threshold: int = THRESHOLD) -> DataFrame:
    """One row per page: id, host, path, rule, weight, verdict."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"),
                         vocabulary_weight(tuple(strict), tuple(soft), threshold)(lower_ascii(url)).alias("weight"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_terms = F.when(F.col("weight") >= threshold, "block").otherwise("allow")
    return parts.select(id_col, "host", "path", rule.alias("rule"),
                        F.coalesce(verdict, by_terms).alias("verdict"), "weight")


def op9_url_filter(spark, sf_dir):
    return filter_urls(read(spark, sf_dir, "pages")).drop("weight")


def oracle() -> str:
    rank = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for h, p, v in rank]
    name = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + \
        f" WHEN weight >= {THRESHOLD} THEN 'block' ELSE 'allow' END"
    hit = "CAST(regexp_matches(u, '(^|[^a-z0-9]){}([^a-z0-9]|$)') AS INT)"
    weight = " + ".join([f"{THRESHOLD} * " + hit.format(t) for t in STRICT] + [hit.format(t) for t in SOFT])
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(url, ''), {az}) AS u,
                  translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), {az}) AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, {weight} AS weight FROM p)
SELECT page_id, host, path, {name} AS rule, {verdict} AS verdict FROM q
"""


ORACLE = oracle()
