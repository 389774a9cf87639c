"""The pipeline's stages against brute force, each on its own input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_ops import WORDS, classes, shingle_sets

PHRASE_WORDS = 70


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    folder = tmp_path_factory.mktemp("tables")
    bad = ["zorgle", "blaxen", "quimfo"]
    item = " ".join(r.choices(WORDS, k=40))
    phrase = " ".join(r.choices(WORDS, k=PHRASE_WORDS))
    rows, labels = [], []
    for i in range(600):
        w = r.choices(WORDS, k=r.choice([8, 60, 120]))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(bad)
        if i % 50 == 7:
            w += item.split()
        if i % 40 == 9:
            w = w[:5] + phrase.split() + w[5:]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    for i in range(600, 680):
        w = rows[r.randrange(600)][1].split()
        if i % 2 and len(w) > 50:
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(rows), item, phrase, bad


def test_stages(spark, tables):
    folder, rows, item, phrase, bad = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    def text_of(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    one = stage["toxicity"](spark, docs, folder)
    assert one.columns == columns
    kept = text_of(one)
    assert set(kept) == {i for i, t in rows.items() if not any(b in (t or "") for b in bad)}
    assert kept[900] is None

    two = stage["ngram_jaccard_join"](spark, one, folder)
    assert two.columns == columns
    root = classes(shingle_sets(list(kept.items()), 5), 80, 100)
    assert set(text_of(two)) == {i for i in kept if root[i] == i}

    three = stage["suffix_array_dedup"](spark, two, folder)
    assert three.columns == columns
    seen, want = set(), {}
    for i, t in sorted(text_of(two).items()):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(b[p : p + 100])
        cut = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
        if not gone or not all(gone):
            want[i] = None if t is None else cut
    got = {r["doc_id"]: r for r in three.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert sum(phrase in (t or "") for t in want.values()) == 1
    assert all(r["n_chars"] == len(r["text"] or "") and r["lang"] == "en" for r in got.values())

    four = stage["decontamination"](spark, three, folder)
    assert four.columns == columns
    sh = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for k in range(len(w) - 4)}
    assert set(text_of(four)) == {i for i, t in want.items() if len(sh(t) & sh(item)) < 0.8 * len(sh(item))}
    assert set(text_of(four)) < set(want)

    five = stage["bpe_codec"](spark, four, folder)
    assert five.count() == four.count()


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert out.count() > 300
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in out.collect())


def test_stages_on_odd_tables(spark, tables):
    """Empty tables, repeated rows, null ids, and columns whose names the operators use inside or that hold dots."""
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40")
    odd = docs.unionAll(docs.limit(3)).unionAll(docs.where("doc_id = 1").withColumn("doc_id", F.expr("cast(null as long)")))
    for name in ("score", "predicted", "n_removed", "component_id", "_copy", "_leak", "no_id", "h", "a.b", "kept"):
        odd = odd.withColumn(name, F.lit(name))
    odd = odd.withColumn("at", F.timestamp_micros(F.lit(1_700_000_000_123_456)))
    kept = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), folder).count() == 0, name
        kept = stage(spark, kept, folder)
        assert kept.schema.simpleString() == odd.schema.simpleString(), name
    rows = kept.collect()
    assert rows and all(r[c] == c for r in rows for c in ("score", "predicted", "n_removed", "component_id", "_copy", "_leak", "no_id", "h", "a.b", "kept"))
    assert {r["at"].microsecond for r in rows} == {123456}
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd.limit(0), folder).count() == 0 and last(spark, kept, folder).count() == len(rows)
