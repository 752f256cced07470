"""The pipeline stage by stage on planted documents, and its registration."""

import random
import subprocess
import sys
import zlib

import samples
from tokenizers import Tokenizer

import corpus_pipeline
from noticelake.llm import packing, queries


def _tables(spark, folder):
    r = random.Random(8)
    clean = [(i, samples.prose(i + 100, 120) + ".") for i in range(40)]
    junk = [(100 + i, " | ".join(f"{chr(97 + r.randrange(26))}unk{r.randrange(9999)}" for _ in range(90))) for i in range(40)]
    passage = samples.prose(777, 70)
    item = samples.prose(888, 30)
    planted = [
        (200, samples.prose(901, 300)), (201, samples.prose(901, 300)),
        (210, f"{samples.prose(902, 100)} {passage} {samples.prose(903, 100)}"),
        (211, f"{samples.prose(904, 100)} {passage} {samples.prose(905, 100)}"),
        (220, f"{samples.prose(906, 100)} {item} {samples.prose(907, 60)}"), (230, None), (231, ""),
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in clean + junk + planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t in clean}, {i for i, _ in junk}


def test_stages(spark, tmp_path):
    clean, junk = _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/out/{n}")
        docs = spark.read.parquet(f"{tmp_path}/out/{n}")
        kept.append({r.doc_id: r for r in docs.collect()})
    quality, near, cut, last = kept
    assert not junk & set(quality) and set(clean) <= set(quality)
    assert 200 in near and 201 not in near and set(clean) <= set(near)
    assert set(cut) == set(near)
    assert samples.prose(777, 70) in cut[210].text and samples.prose(777, 70) not in cut[211].text
    assert len(samples.WORD.findall(cut[211].text)) == 200 and cut[211].n_chars == len(cut[211].text)
    assert 220 not in last and set(cut) - set(last) == {220}
    assert all(last[i].text == t for i, t in clean.items())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    for i, r in last.items():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        pieces = sorted((x.start, x.length, x.ids_crc32) for x in rows if x.doc_id == i)
        assert sum(n for _, n, _ in pieces) == len(ids)
        assert all(c == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[s: s + n])) for s, n, c in pieces)


def test_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(found) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_the_rest_imports_without_this_package(tmp_path):
    """Only __spark_entry__ looks for these operators, and only their absence is forgiven."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('noticelake.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'q01_feed' in names and not any(n.startswith('op') for n in names)\n"
    )
    root = corpus_pipeline.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
