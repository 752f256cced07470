"""Operators 1 and 9: held-out accuracy, the exact arithmetic of the models, odd inputs."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import samples
from pyspark.sql import functions as F

from noticelake.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = docs.select("doc_id", "text", quality.held_out().alias("h"))
    got = quality.scored(rows, model).join(labels, "doc_id").select("h", "score", "quality").collect()
    held = [r for r in got if r.h]
    right = sum((r.score >= quality.THRESHOLD) == bool(r.quality) for r in held)
    assert len(held) > 50 and right / len(held) > 0.95
    assert quality.train(docs, labels).tables[0].tolist() == model.tables[0].tolist()
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()


def plain_features(text: str | None) -> list[float]:
    """The features of one text, word by word."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    kinds = {
        "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
        "beyond": bytes(range(128, 256)), "symbol": b"#*$%&|<>@^~=_+{}[]\\", "loud": b"!?", "stop": b".,;:", "line": b"\n"}
    count = {k: lambda x, v=v: sum(b in v for b in x) for k, v in kinds.items()}
    n, pairs = max(len(words), 1), list(zip(words, words[1:], strict=False))
    letters = [len(w) - sum(count[k](w) for k in ("symbol", "stop", "loud", "digit")) for w in words]
    return [*(count[k](data) / max(len(data), 1) for k in kinds), math.log1p(len(words)), sum(map(len, words)) / n,
            len(set(words)) / n, sum(a == b for a, b in pairs) / n, sum(len(w) == 1 for w in words) / n,
            sum(2 * count["symbol"](w) >= len(w) for w in words) / n,
            sum(k > 1 and count["upper"](w) == k for w, k in zip(words, letters, strict=True)) / n,
            1 - len(set(pairs)) / len(pairs) if pairs else 0.0]


ODD = [None, "", " ", "\n" * 400 + "one two one", "one two one", "two six", "a", "A!", "ÑANDÚ ñandú", "### *** x_y {}", "X " * 700,
       "  lead", "trail \n\n", "a b a b a b", "12 3.4, NASA; WHO? \x00\x1c\x85", "y" * 70_000, "\t\x0b\x0c\r"]


def test_features_equal_brute_force_in_any_company():
    texts = [*ODD, *(samples.prose(i, 40 * i) for i in range(1, 30)), *ODD[::-1]]
    want = np.array([plain_features(t) for t in texts])
    assert np.allclose(quality.features(pa.array(texts, pa.string())), want, rtol=0, atol=1e-12)
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert (alone == quality.features(pa.array(texts, pa.string()))).all()


def test_partitioning_changes_no_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    one, two = ({r.doc_id: r.score for r in quality.scored(df, model).collect()} for df in (docs, docs.repartition(13)))
    assert one == two


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs
    score = model.score(x)
    assert ((score > 0.5) == y).mean() > 0.9
    for i in range(20):
        total = model.intercept
        for f in range(3):
            total += model.tables[f][sum(e <= x[i, f] for e in model.edges[f])]
        for (f, g), table in model.pairs.items():
            at = [sum(e <= x[i, k] for e in model.pair_edges[k]) for k in (f, g)]
            total += table[at[0], at[1]]
        assert math.isclose(score[i], 1 / (1 + math.exp(-total)))


def test_quality_of_odd_rows(spark):
    docs = samples.frame(spark)
    labels = spark.createDataFrame(
        [(0, 1, 0), (9, 0, 0), (16, 0, 1), (12, 1, None), (14, None, 0), (None, 1, 0)],
        "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.scored(docs.drop("score"), model).collect()
    assert len(got) == len(samples.rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "")}) == 1
    none = labels.filter("quality > 5")
    assert {r.score for r in quality.scored(docs.drop("score"), quality.train(docs, none)).collect()} == {0.5}
    assert quality.scored(samples.frame(spark, []).drop("score"), model).count() == 0
    assert quality.keep_good(docs, model).schema == docs.schema


def test_features_of_whole_texts():
    texts = ["", None, "A a a B.\nb 12 ###", "x " * 5000 + "LAST"]
    x = dict(zip(quality.FEATURES, quality.features(pa.array(texts)).T, strict=True))
    assert x["words"].tolist() == [0, 0, math.log1p(7), math.log1p(5001)]
    assert x["same_as_before"][2] == 1 / 7 and x["distinct"][2] == 6 / 7
    assert x["symbol_words"][2] == 1 / 7 and x["distinct"][3] == 2 / 5001 and x["upper"][3] > 0


def kneser_ney(texts: list[str]):
    """Interpolated Kneser-Ney of order 4 over dictionaries."""
    counts: list[Counter] = [Counter() for _ in range(5)]
    for text in texts:
        codes, begins = language.symbols([text])
        padded = [0, 0, 0, *codes.tolist()]
        for i in range(4, len(padded)):
            counts[4][tuple(padded[i - 3: i + 1])] += 1
    for order in (3, 2, 1):
        for gram in counts[order + 1]:
            counts[order][gram[1:]] += 1
    discount, sums, kinds = {}, {}, {}
    for order in range(1, 5):
        n = Counter(counts[order].values())
        discount[order] = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        sums[order], kinds[order] = Counter(), Counter()
        for gram, c in counts[order].items():
            sums[order][gram[:-1]] += c
            kinds[order][gram[:-1]] += 1

    def p(gram, symbols):
        if not gram:
            return 1 / (symbols + 1)
        order, context = len(gram), gram[:-1]
        lower = p(gram[1:], symbols)
        if not sums[order][context]:
            return lower
        d, total = discount[order], sums[order][context]
        return max(counts[order][gram] - d, 0) / total + d * kinds[order][context] / total * lower

    return p, {g[0] for g in counts[1]}


def test_probabilities_are_kneser_ney(spark):
    texts = {"en": ["the cat sat on the mat", "a theme that thaws"], "de": ["der hund und die katze", "und der tag"]}
    ids = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 5 > 1]
    data = [(ids.pop(), t, lang, "s", 1, "x", 1, "k", None, 1, 2) for lang, ts in texts.items() for t in ts]
    models = language.train(samples.frame(spark, data))
    assert models.languages == ["de", "en"]
    built = {lang: kneser_ney(ts) for lang, ts in texts.items()}
    symbols = len(built["de"][1] | built["en"][1])
    packed, _ = language.grams(*language.symbols(["the der Übertag xyz cat"]))
    logs = models.log_probability(language.ORDER, packed)
    for g, row in zip(packed.tolist(), logs, strict=True):
        gram = tuple(g >> 16 * k & 0xFFFF for k in (3, 2, 1, 0))
        for lang, value in zip(models.languages, row, strict=True):
            assert math.isclose(value, math.log(built[lang][0](gram, symbols)), rel_tol=1e-4, abs_tol=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.accepted for r in got) / len(got) > 0.95


def test_languages_of_odd_rows(spark):
    docs = samples.frame(spark)
    got = defaultdict(set)
    for r in language.identify(docs, language.train(docs)).collect():
        got[r.doc_id].add((r.lang_pred, r.score > 0))
    assert got[6] == got[7] == got[8] == {("und", False)} and ("en", True) in got[14] and len(got[15]) == 1
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(docs, language.train(nothing)).collect()} == {"und"}
    empty = samples.frame(spark, [])
    assert language.identify(empty, language.train(empty)).count() == 0


def test_letters_outside_the_basic_plane():
    codes, begins = language.symbols(["a1 2b", "𐐀x", "😀", "", None])
    assert begins.tolist() == [0, 5, 9, 10, 11]
    assert (codes[:5] > 0).tolist() == [False, True, False, True, False] and (codes[6:8] > 0).all()


def test_all_documents_that_are_not_held_out_are_learnt(spark):
    """Those that calibrate the score count too, and a language with no others is known."""
    share = {i: __import__("zlib").crc32(str(i).encode()) % 5 for i in range(400)}
    ids = [i for i in share if share[i] > 0]
    texts = {"en": "the cat sat on the mat", "de": "der hund und die katze"}
    data = [(i, f"{texts[lang]} {chr(97 + i % 26) * 3}", lang) for n, i in enumerate(ids) for lang in [["en", "de"][n % 2]]]
    only = next(i for i in ids if share[i] == 1)
    data = [r for r in data if r[0] != only] + [(only, "γάτα στο χαλί", "el")]
    docs = samples.frame(spark, [(*r, "s", 1, "x", 1, "k", None, 1, 2) for r in data])
    models = language.train(docs)
    assert models.languages == ["de", "el", "en"]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, models).collect()}
    assert got[only] == "el" and len(models.usual) == 3
    packed, _ = language.grams(*language.symbols([t for _, t, _ in data]))
    assert set(np.unique(packed).tolist()) <= set(models.keys[-1].tolist())


def test_models_in_parts_give_the_same_result(spark, monkeypatch):
    """A pass per part; no n-gram is left out, whatever the parts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = language.train(docs)
    want = {r.doc_id: r for r in language.identify(docs, one).collect()}
    monkeypatch.setattr(language, "CELLS", 60_000)
    cut = language.train(docs)
    assert cut.parts > 1 and one.parts == 1
    assert sorted(k for p in range(cut.parts) for k in cut.of(p).keys[3].tolist()) == one.keys[3].tolist()
    for r in language.identify(docs, cut).collect():
        w = want[r.doc_id]
        assert (r.lang_pred, r.accepted) == (w.lang_pred, w.accepted)
        assert math.isclose(r.cross_entropy, w.cross_entropy, rel_tol=1e-9) and math.isclose(r.score, w.score, abs_tol=1e-6)


def test_a_larger_corpus_keeps_all_ngrams_of_the_smaller(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    small = docs.filter("doc_id < 1000")
    few, many = (set(language.train(x).keys[3].tolist()) for x in (small, docs))
    assert few < many


def test_score_follows_all_documents_that_are_learnt(spark):
    """Wrong labels lower the score wherever they stand, not only in one part of the documents."""
    share = {i: __import__("zlib").crc32(str(i).encode()) % 5 for i in range(600)}
    texts = {"en": "the cat sat on the mat", "de": "der hund und die katze"}
    data = []
    for n, i in enumerate(i for i in share if share[i] > 0):
        lang, other = (("en", "de"), ("de", "en"))[n % 2]
        data.append((i, f"{texts[lang]} {chr(97 + i % 26) * 3}", other if share[i] > 1 and i % 3 == 0 else lang))
    docs = samples.frame(spark, [(*r, "s", 1, "x", 1, "k", None, 1, 2) for r in data])
    scores = [r.score for r in language.identify(docs, language.train(docs)).collect()]
    right = sum(share[i] == 1 or i % 3 > 0 for i, _, _ in data) / len(data)
    assert right < 0.75 and sum(scores) / len(scores) < 0.8
