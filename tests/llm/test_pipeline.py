"""The pipeline's stages against brute force, each on its own input."""

import random
import re

import pytest
import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.support import brute_components, brute_removed
from tidefold.llm import packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioutnsrl") for _ in range(r.randrange(2, 8))) for _ in range(120)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, rows = prose(55), []
    for i in range(60):
        text = prose(r.randrange(20, 150))
        if i % 9 == 3:
            text = rows[-1][1] + (" added at the end" if i % 2 else "")
        elif i % 6 == 1:
            text = text + " " + passage + " " + prose(100)
        elif i % 10 == 5:
            text = " ".join(f"{w.upper()}###{i}&&&" for w in text.split())
        rows.append((i, text))
    rows += [(60, None), (61, ""), (62, "one")]
    bad = {i for i, t in rows if t and "###" in t}
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], [(i, int(i not in bad), 0) for i, _ in rows if i % 3]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = made(3)
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, tables):
    path, given = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), "test")
        out.append(docs)
    good, single, cut, packed = out
    assert all(d.columns == [c.split()[0] for c in COLUMNS.split(", ")] for d in out[:3])
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(kept) == {i for i, t, *_ in given if not (t and "###" in t)} and all(kept[i] == t for i, t, *_ in given if i in kept)
    root = brute_components(list(kept.items()), 80)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert texts == {i: t for i, t in kept.items() if root[i] == i}
    rows = sorted(texts.items())
    want = {rows[i][0]: words for i, (_, _, words) in brute_removed(rows, 20).items()}
    final = {r["doc_id"]: r for r in cut.collect()}
    assert {i: WORD.findall(r["text"] or "") for i, r in final.items()} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in final.values())
    assert any(len(w) < len(WORD.findall(texts[i] or "")) for i, w in want.items())
    sums = {}
    for r in packed.collect():
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= r["sequence_tokens"] <= 2048
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    assert sums == {i: len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in final.items()}


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Rows without an id, repeated rows and ids, a very long text, null and empty ones, and columns named as those in between."""
    r = random.Random(6)
    prose = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    plain = [prose(60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(plain)] + [(3, plain[3]), (3, prose(50)), (None, plain[5]), (None, plain[6]), (20, prose(300_000)), (21, None), (22, ""), (23, plain[7]), (None, None)]
    clash = ["id", "block", "component", "h", "key", "row", "_row", "trusted", "_id", "z", "substring_words"]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS).withColumns({c: F.lit("clash") for c in clash})
    path = f"file://{tmp_path}"
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(24)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, path), "test")
        if name != "packing":
            assert docs.columns == before.columns
            counts.append(sorted((str(x["doc_id"]), len(x["text"] or "")) for x in docs.select("doc_id", "text").collect()))
    assert counts[0] == sorted((str(i), len(t or "")) for i, t in rows)
    assert counts[1] == sorted((str(i), len(t or "")) for i, t in rows if i != 23)
    assert ("None", 0) in counts[2] and len(counts[2]) == len(counts[1])
    sums = {}
    for x in docs.collect():
        sums[x["doc_id"]] = sums.get(x["doc_id"], 0) + x["length"]
    assert sums[21] == sums[22] == 1 and sums[20] > 300_000
