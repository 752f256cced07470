"""Quality rules by distribution divergence (operator 6), in DataFrame functions alone.

A text's shares of character classes and its shares of common words are compared with references
of each language by the Jensen-Shannon distance; the nearest language counts. References come
from all documents of the table that pass the base rules and the length guards: per class the
median share, per word the mean share. Texts below a guard are not judged by that histogram.
Languages without a list of common words have references of classes alone, for the documents that
name them, once ``MIN_DOCUMENTS`` such documents are there.

Repeated windows of five words are found by sorting 64-bit hashes of the windows within the row,
so nothing is shuffled but the sums of the references.

Defined results: a null text has no words and fails the base rules; texts are read whole; ties do
not arise; repeated rows are judged alike; documents without a lang count in no reference and are
judged by the listed languages; documents of a lang without a reference, and all where there is none,
are judged by the base rules alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.repeats import stored

#: Common words of each reference language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so sie".split(),
    "en": "the of and to in a is that it was for on are as with his they at be this from or had by not but".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
#: Removed one after another; what is left is the last class.
CLASSES = {
    "lower": "[a-z]+", "space": r"\s+", "upper": "[A-Z]+", "digit": "[0-9]+",
    "mark": r"""[.,;:!?'"()-]+""", "letter": r"\p{L}+",
}
MIN_WORDS = 10
MAX_REPEATED = 20  # percent
#: Guards and largest distances of the two histograms.
CLASS_GUARD, CLASS_DISTANCE = 30, 0.2
WORD_GUARD, WORD_DISTANCE = 100, 0.45
MIN_DOCUMENTS = 50
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"


def _variants() -> list[str]:
    """Common words as they stand in texts: small, capitalised, before a comma or a stop."""
    return sorted({x + end for w in WORDS for x in (w, w.capitalize(), w.upper()) for end in ("", ",", ".")})


def measured(docs: DataFrame) -> DataFrame:
    """Counts of each text: the base columns, ``classes`` (one per class) and ``common`` (bin, n)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    start = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), text.alias("t"),
        F.array_remove(F.split(text, SPACE), "").alias("w"))
    n = F.size("w")

    def window(word: Column, i: Column) -> Column:
        return F.xxhash64(word, *(F.get(F.col("w"), i + k) for k in range(1, WINDOW)))

    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    rest, classes = F.col("t"), []
    for pattern in CLASSES.values():
        left = F.regexp_replace(rest, pattern, "")
        classes.append((F.char_length(rest) - F.char_length(left)).cast("long"))
        rest = left
    classes.append(F.char_length(rest).cast("long"))
    listed = ",".join(WORDS)
    common = F.filter("w", lambda x: x.isin(_variants()))
    bins = F.transform(common, lambda x: F.find_in_set(F.rtrim(F.lower(x), F.lit(",.")), F.lit(listed)))
    first = start.select(
        "doc_id", "lang", n.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(F.slice("w", 1, F.greatest(n - (WINDOW - 1), F.lit(0))), window).alias("h"),
        F.array(*classes).alias("classes"), F.sort_array(bins).alias("bins"))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    second = first.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "classes", "bins",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"),
        F.array_distinct("bins").alias("kinds"))
    s = F.col("s")

    def twice(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(s, i + 1)["h"] == x["h"], F.lit(False))

    third = second.withColumn("at", F.sort_array(F.transform(F.filter("s", twice), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b)
    # Sorted bins: a kind's count is the distance between its first place and the next kind's.
    ends = F.transform("kinds", lambda k, i: F.coalesce(
        F.array_position(F.col("bins"), F.get(F.col("kinds"), i + 1)) - 1, F.size("bins").cast("long")))
    fourth = third.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "classes", "kinds", ends.alias("ends"))
    counts = F.transform("kinds", lambda k, i: F.struct(
        k.alias("bin"), (F.get(F.col("ends"), i) - F.when(i > 0, F.get(F.col("ends"), i - 1)).otherwise(0)).alias("n")))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return fourth.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "classes", counts.alias("common"))


def _total(array: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, b: a + b)


def references(counts: DataFrame) -> dict[str, tuple[list[float], dict[int, float]]]:
    """Per language the shares of the classes and, where it is listed, of the common words.

    ``counts`` is read several times, so it should be a written table. One row per language, or
    per listed language and word, reaches the driver.
    """
    listed = F.col("lang").isin(sorted(COMMON))
    known = counts.filter(F.col("lang").isNotNull() & ~F.col("base_failed"))
    shares = known.filter(F.col("n_words") >= CLASS_GUARD).withColumn("total", _total("classes"))
    k = len(CLASSES) + 1
    medians = shares.groupBy("lang").agg(F.count("*").alias("documents"), *(
        F.percentile_approx(F.get("classes", F.lit(i)) / F.col("total"), 0.5, 10_000).alias(f"c{i}")
        for i in range(k))).filter(listed | (F.col("documents") >= MIN_DOCUMENTS)).collect()
    long = known.filter(listed & (F.col("n_words") >= WORD_GUARD))
    sizes = {r["lang"]: r["n"] for r in long.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    words = long.select("lang", "n_words", F.inline("common")).groupBy("lang", "bin").agg(
        F.sum(F.col("n") / F.col("n_words")).alias("share")).collect()
    found = {}
    for row in medians:
        total = sum(row[f"c{i}"] for i in range(k)) or 1.0
        found[row["lang"]] = ([row[f"c{i}"] / total for i in range(k)], {})
    for row in words:
        if row["lang"] in found:
            found[row["lang"]][1][row["bin"]] = row["share"] / sizes[row["lang"]]
    return found


def _part(p: Column, q: Column) -> Column:
    """p log2(2 p / (p + q)) + q log2(2 q / (p + q)), with 0 log 0 = 0."""
    def side(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    return side(p, q) + side(q, p)


def class_distance(shares: list[Column], reference: list[float]) -> Column:
    parts = sum((_part(p, F.lit(float(q))) for p, q in zip(shares, reference, strict=True)), F.lit(0.0))
    return F.sqrt(F.greatest(parts / 2, F.lit(0.0)))


def word_distance(reference: dict[int, float]) -> Column:
    """Common words are bins of their own, all others one bin together."""
    n = F.col("n_words").cast("double")
    known = F.array(*(F.lit(float(reference.get(b, 0.0))) for b in range(len(WORDS) + 1)))
    known_all = sum(reference.values())
    # Bins the text lacks give q each; so start from all of the reference and correct those it has.
    gained = F.aggregate(
        F.transform("common", lambda x: _part(x["n"] / n, F.get(known, x["bin"])) - F.get(known, x["bin"])),
        F.lit(0.0), lambda a, b: a + b)
    others = (n - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x["n"])) / n
    rest = _part(others, F.lit(max(0.0, 1.0 - known_all)))
    return F.sqrt(F.greatest((gained + F.lit(known_all) + rest) / 2, F.lit(0.0)))


def judged(docs: DataFrame) -> DataFrame:
    """The base columns, the distances to the nearest language, and ``kept``."""
    counts = stored(measured(docs), "rule-counts")
    found = references(counts)
    far = F.lit(None).cast("double")
    total = F.greatest(_total("classes"), F.lit(1)).cast("double")
    shares = [F.get("classes", F.lit(i)) / total for i in range(len(CLASSES) + 1)]
    judged_by = []
    for lang in sorted(set(found) & set(COMMON)):
        classes, words = found[lang]
        by_class = F.when(F.col("n_words") >= CLASS_GUARD, class_distance(shares, classes) / CLASS_DISTANCE)
        by_word = (F.when(F.col("n_words") >= WORD_GUARD, word_distance(words) / WORD_DISTANCE)
                   if words else far)
        judged_by.append(F.greatest(F.coalesce(by_class, F.lit(0.0)), F.coalesce(by_word, F.lit(0.0))))
    # A lang that is not listed is looked up, and least() passes over the null of all others: neither a
    # branch nor the number of languages makes the expression larger.
    own = F.lit(0.0)
    if others := sorted(set(found) - set(COMMON)):
        table = F.create_map(*(F.lit(x) for lang in others for x in (lang, found[lang][0])))
        mine = F.try_element_at(table, F.col("lang"))
        parts = [_part(p, F.get(mine, F.lit(i))) for i, p in enumerate(shares)]
        far = F.sqrt(F.greatest(sum(parts, F.lit(0.0)) / 2, F.lit(0.0))) / CLASS_DISTANCE
        own = F.when(mine.isNotNull() & (F.col("n_words") >= CLASS_GUARD), far).otherwise(0.0)
    unlisted = F.when(~F.col("lang").isin(sorted(COMMON)), own)
    distance = F.least(*judged_by, unlisted) if judged_by else F.lit(0.0)
    return counts.withColumn("distance", distance).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("distance") <= 1.0)).alias("kept"), "distance")
