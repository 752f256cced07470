"""URL filter by host word segmentation (operator 7).

Allow and block rules come first. All other urls are judged by multinomial naive Bayes over the
words of the host and of the path, learnt from the urls that a rule judges. Host names run words
together, so the letters of each label are split by a unigram Viterbi search, with word counts
from the texts of all pages. Segmentation works on the different label pieces only: their
substrings are joined with the word counts, so neither table is ever broadcast by this module.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by
the prior; a label piece longer than a DNS label (63) stays one word; words that never occur get
a probability that falls tenfold per letter; ties allow; without urls of both kinds under a rule
every other url is allowed; repeated rows are judged alike; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.repeats import stored

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MAX_LABEL = 63
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, for a short list. ``with_rules`` takes tables of any size."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (stored, with host and path) and the longest fitting ``rule`` with what it ``says``.

    ``rules`` is a table (host, path, verdict). Tails of a host, no longer in labels than the longest rule
    host, meet the different path lengths of the rules of that tail; prefixes of these lengths then meet the
    rules themselves. So a url makes a row per tail and length that occurs, never one per rule. Of equally
    long rules the one that sorts last wins; rules with a null fit nothing; a rule may be listed twice.
    """
    rules = stored(rules.select("host", "path", "verdict").na.drop().distinct(), "rules")
    widest = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"]
    if widest is None:
        none = F.lit(None).cast("string")
        return urls.withColumn("rule", none).withColumn("says", none)
    lengths = rules.groupBy(F.col("host").alias("tail")).agg(F.collect_set(F.length("path")).alias("lengths"))
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(widest))), lambda n: F.array_join(
        F.slice(labels, F.size(labels) - n + 1, n), "."))
    asked = places.select("host", "path", F.explode(tails).alias("tail")).join(lengths, "tail").select(
        "host", "path", "tail", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.withColumn("start", F.substring("path", F.lit(1), F.col("n")))
    listed = rules.select(F.col("host").alias("tail"), F.col("path").alias("start"), "verdict")
    order = F.struct(F.length("tail") + F.length("start"), "tail", "start", "verdict")
    best = asked.join(listed, ["tail", "start"]).groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("tail", "start").alias("rule"), F.col("verdict").alias("says")), order).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "best.rule", "best.says")


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: ASCII words in the visible text of all pages."""
    visible = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    words = pages.select(F.explode(F.split(visible, r"[^\p{L}]+")).alias("word"))
    return words.filter(F.rlike("word", F.lit("^[a-z]+$"))).groupBy("word").agg(F.count("*").alias("n"))


def _best_split(total: int):
    def split(piece: str, known: list[dict]) -> list[str]:
        logs = {(k["i"], k["m"]): math.log(k["n"] / total) for k in known}
        best, back = [0.0] + [-math.inf] * len(piece), [0] * (len(piece) + 1)
        for end in range(1, len(piece) + 1):
            for start in range(end):
                m = end - start
                log = logs.get((start, m))
                if log is None:  # a word of m letters that never occurs
                    log = math.log(10.0 / total) - m * math.log(10.0)
                if best[start] + log > best[end]:
                    best[end], back[end] = best[start] + log, start
        out, end = [], len(piece)
        while end:
            out.append(piece[back[end]: end])
            end = back[end]
        return out[::-1]

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pieces, known = batch.column("piece").to_pylist(), batch.column("known").to_pylist()
            words = [split(p, k or []) if len(p) <= MAX_LABEL else [p] for p, k in zip(pieces, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(words, pa.list_(pa.string()))],
                                             ["piece", "words"])

    return emit


def segmented(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """``piece`` and its ``words``, for different pieces of letters."""
    total = max(1, counts.agg(F.sum("n")).first()[0] or 1)
    size = F.length("piece")
    starts = pieces.filter(size <= MAX_LABEL).select(
        "piece", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    stretches = starts.select("piece", "i", F.explode(F.sequence(F.lit(1), size - F.col("i"))).alias("m"))
    word = F.substring("piece", F.col("i") + 1, F.col("m"))
    known = stretches.withColumn("word", word).join(counts, "word").groupBy("piece").agg(
        F.collect_list(F.struct("i", "m", "n")).alias("known"))  # at most 63 * 64 / 2 for a piece
    return pieces.join(known, "piece", "left").mapInArrow(
        _best_split(total), "piece string, words array<string>")


def _log_ratios(tokens: DataFrame) -> DataFrame:
    """token, llr from token, allow, block (counts per token)."""
    sums = tokens.agg(F.sum("allow").alias("a"), F.sum("block").alias("b"), F.count("*").alias("v")).first()
    allow, block, kinds = sums["a"] or 0, sums["b"] or 0, sums["v"] or 0
    return tokens.select("token", (
        F.log((F.col("block") + 1.0) / (block + kinds + 1.0)) - F.log((F.col("allow") + 1.0) / (allow + kinds + 1.0))
    ).alias("llr"))


def judged(pages: DataFrame, rules: list[Rule] | DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the score of naive Bayes (above 0: block).

    A short list of rules becomes conditions; a table of rules (host, path, verdict) is joined.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        urls = stored(with_rules(stored(urls, "parts"), rules), "urls")
    else:
        rule, says = rule_of(RULES if rules is None else rules, F.col("host"), F.col("path"))
        urls = stored(urls.withColumn("rule", rule).withColumn("says", says), "urls")
    votes = [F.coalesce(F.sum(F.when(F.col("says") == v, 1).otherwise(0)), F.lit(0)).alias(v)
             for v in ("allow", "block")]

    by_host, by_path = (urls.groupBy(c).agg(*votes) for c in ("host", "path"))
    pieces = by_host.select("host", "allow", "block", F.explode(F.expr(
        "regexp_extract_all(host, '[a-z]+', 0)")).alias("piece"))
    words = stored(segmented(pieces.select("piece").distinct(), stored(word_counts(pages), "words")), "pieces")
    host_tokens = stored(pieces.join(words, "piece").select(
        "host", "allow", "block", F.explode("words").alias("word")).select(
        "host", "allow", "block", F.concat(F.lit("h:"), "word").alias("token")), "host-tokens")
    part = F.explode(F.array_remove(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), ""))
    path_tokens = by_path.select("path", "allow", "block", part.alias("x")).select(
        "path", "allow", "block", F.concat(F.lit("p:"), F.when(F.rlike("x", F.lit("^[0-9]+$")), "#").otherwise(
            F.col("x"))).alias("token"))
    sums = [F.sum(v).alias(v) for v in ("allow", "block")]
    ratios = stored(_log_ratios(stored(host_tokens.groupBy("token").agg(*sums).unionByName(
        path_tokens.groupBy("token").agg(*sums)), "tokens")), "ratios")
    scores = [t.join(ratios, "token").groupBy(c).agg(F.sum("llr").alias(f"{c}_score"))
              for t, c in ((host_tokens, "host"), (path_tokens, "path"))]
    seen = urls.agg(*votes).first()
    trained = bool(seen["allow"] and seen["block"])
    prior = math.log((seen["block"] + 1) / (seen["allow"] + 1)) if trained else 0.0
    scored = urls.join(scores[0], "host", "left").join(scores[1], "path", "left")
    score = F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)) + prior
    score = score if trained else F.lit(0.0)
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("says", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
