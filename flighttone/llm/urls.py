"""Verdicts on URLs: rules first, else naive Bayes over segmented host and path names.

Names are runs of a-z in host and path.  A concatenated name is split into words by
Viterbi over unigram counts of all words in the pages' own text.  The word counts are
never held by one task: each distinct name's substrings are joined to them, and a name
is split with the counts of its own substrings.  URLs whose words hold one of a few
unwanted terms are the blocked examples of a multinomial naive Bayes, all
others the allowed ones, so words that keep company with such terms count as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.scale import join_unique, materialize

#: Rules as verdict, host and path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms that mark an example as blocked.
TERMS = (
    "adult", "ads", "bets", "betting", "casino", "crack", "escort", "lottery", "malware", "payday", "phishing",
    "pills", "poker", "porn", "sex", "spam", "torrent", "viagra", "warez", "xxx",
)
#: Letters of the longest word looked for; longer words of the pages are not counted.
LONGEST = 24
#: One in so many names tells how often each word is met, to find the words that are met very often.
SAMPLED = 64
#: Times each term is added to the words of the pages, so that names are split at it.
TERM_COUNT = 100
SMOOTHING = 1.0


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a URL; both are empty where it is null or has no ``://``."""
    c = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(c, "://")
    rest = F.when(at > 0, F.substr(c, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return lowered(host), path


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ruled(rules: Sequence[tuple[str, str, str]], value: str) -> Column:
    """``rule`` or ``verdict`` of the longest rule that fits ``host`` and ``path``, else null."""
    out = F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]))
    for verdict, host, path in order:
        inside = (F.col("host") == host) | F.col("host").endswith("." + host)
        out = F.when(inside & F.col("path").startswith(path), F.lit(host + path if value == "rule" else verdict)).otherwise(out)
    return out


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Words of a-z in all pages, mark-up left out, with the unwanted terms added: ``word, n``."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(lowered(bare), r"[^\p{L}]+")).alias("word"))
    words = words.filter(F.col("word").rlike("^[a-z]+$") & (F.length("word") <= LONGEST))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    terms = F.array(*[F.lit(t) for t in TERMS])
    extra = pages.sparkSession.range(1).select(F.explode(terms).alias("word"), F.lit(TERM_COUNT).cast("long").alias("n"))
    return counted.unionByName(extra).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of a name; unknown words pay ten times for each letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for begin in range(max(0, end - LONGEST), end):
            word = name[begin:end]
            n = counts.get(word)
            p = math.log(n / total) if n else math.log(10 / total) - len(word) * math.log(10)
            options.append((best[begin][0] + p, begin))
        best.append(max(options))
    words, end = [], len(name)
    while end:
        begin = best[end][1]
        words.append(name[begin:end])
        end = begin
    return words[::-1]


def _spans(names: DataFrame) -> DataFrame:
    """Substrings of at most ``LONGEST`` letters: ``n1, n2, word``, each once for a name; names by hash, as they may be long."""
    return (
        names.withColumn("begin", F.explode(F.sequence(F.lit(1), F.length("name"))))
        .withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("begin") + 1))))
        .select("n1", "n2", F.substr("name", "begin", "size").alias("word")).distinct()
    )


def split_names(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Words of each distinct ``name``: ``name, words``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = [
                viterbi(n, dict(zip(w, c)), total) for n, w, c in zip(frame["name"], frame["held"], frame["times"])
            ]
            yield pd.DataFrame({"name": frame["name"], "words": words})

    hashed = names.withColumns({"n1": F.xxhash64("name"), "n2": F.xxhash64(F.lit(1), "name")})
    # Single letters and the like are in nearly all names.
    some = _spans(hashed.filter(F.pmod("n1", F.lit(SAMPLED)) == 0)).groupBy("word").agg((F.count(F.lit(1)) * SAMPLED).alias("met"))
    weighted = materialize(counts.join(some, "word", "left").withColumn("met", F.coalesce("met", F.lit(0))))
    known = join_unique(_spans(hashed), weighted, ["word"], "met").groupBy("n1", "n2").agg(
        F.sort_array(F.collect_list(F.struct("word", "n"))).alias("held")
    )
    each = hashed.join(known, ["n1", "n2"], "left").select(
        "name", F.coalesce(F.col("held.word"), F.array()).alias("held"), F.coalesce(F.col("held.n"), F.array()).alias("times")
    )
    return each.mapInPandas(run, "name string, words array<string>")


def names_of(host: str = "host", path: str = "path") -> Column:
    """Names of host and path in order, each a whole run of letters."""
    runs = F.concat(
        F.regexp_extract_all(F.col(host), F.lit("[a-z]+"), 0), F.regexp_extract_all(lowered(F.col(path)), F.lit("[a-z]+"), 0)
    )
    return F.concat_ws(" ", runs)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    terms: Sequence[str] = TERMS,
) -> DataFrame:
    """Verdict on every page: ``page_id, host, path, rule, verdict, score``.

    A rule fits its host and all subdomains where the path starts with its own;
    the longest wins.  Where none fits, ``score`` above 0 blocks: the log odds of naive Bayes,
    null where the URL has no name, which is allowed unless blocked pages are the
    majority.  Null URLs and URLs without ``://`` have empty host and path.  Null
    pages (html) have no words; repeated rows count each; null ids are kept; an empty
    table gives no rows; other columns are not read.
    """
    host, path = parts()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("names", names_of())
    # URLs with the same names share a score, so a hot host is added up before it moves.
    keys = materialize(urls.groupBy("names").agg(F.count(F.lit(1)).alias("pages")))
    counts = materialize(word_counts(pages))
    total = counts.agg(F.sum("n")).first()[0]
    each = keys.select("names", "pages", F.posexplode(F.split("names", " ")).alias("at", "name")).filter("name <> ''")
    met = materialize(each.groupBy("name").agg(F.count(F.lit(1)).alias("met")))
    split = split_names(met.select("name"), counts, total).join(met, "name")
    words = materialize(
        join_unique(each, materialize(split), ["name"], "met").select("names", "pages", F.explode("words").alias("word"))
        .groupBy("names", "pages", "word").agg(F.count(F.lit(1)).alias("times"))
    )
    marked = words.groupBy("names").agg(F.max(F.col("word").isin(*terms)).alias("bad"))
    learned = words.join(marked, "names").groupBy("word").agg(
        F.sum(F.when(F.col("bad"), F.col("pages") * F.col("times")).otherwise(0)).alias("bad"),
        F.sum(F.when(~F.col("bad"), F.col("pages") * F.col("times")).otherwise(0)).alias("good"),
        F.count(F.lit(1)).alias("met"),
    )
    sums = learned.agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
    bad, good, size = (float(x or 0) for x in sums)
    of = keys.join(marked, "names", "left").agg(F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0)), F.sum("pages")).first()
    n_bad, n_all = (float(x or 0) for x in of)
    prior = math.log(n_bad + 1) - math.log(n_all - n_bad + 1)
    odds = learned.select(
        "word", "met",
        (F.log((F.col("bad") + SMOOTHING) / (bad + SMOOTHING * size + 1e-300))
         - F.log((F.col("good") + SMOOTHING) / (good + SMOOTHING * size + 1e-300))).alias("odds"),
    )
    scores = join_unique(words, materialize(odds), ["word"], "met").groupBy("names").agg((F.sum(F.col("times") * F.col("odds")) + prior).alias("score"))
    scored = urls.join(scores, "names", "left")
    method = F.when(F.coalesce(F.col("score"), F.lit(prior)) > 0, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", ruled(rules, "rule").alias("rule"),
        F.coalesce(ruled(rules, "verdict"), method).alias("verdict"), "score",
    )
