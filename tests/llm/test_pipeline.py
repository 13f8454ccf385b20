"""The pipeline's stages against brute force on the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planwright.llm import quality
from planwright.session import materialize

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], DATA), "test-pipeline"))
    return tables


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_columns(staged):
    assert all(t.columns == staged[0].columns for t in staged[:-1])


def test_quality(staged):
    verdicts = {r.doc_id for r in quality.quality_rules(staged[0]).where("kept").collect()}
    assert set(texts(staged[1])) == verdicts


def test_line_dedup(staged):
    before, after, first = texts(staged[1]), texts(staged[2]), {}
    keys = {d: [(line, lower(line.strip(" \t\n\x0b\x0c\r"))) for line in (t or "").split("\n")] for d, t in before.items()}
    for d in sorted(keys):
        for _, key in keys[d]:
            first.setdefault(key, d)
    want = {d: "\n".join(line for line, key in lines if len(key) < 10 or first[key] == d) for d, lines in keys.items()}
    assert after == {d: t for d, t in want.items() if t == (before[d] or "") or re.search(r"[^ \t-\r]", t)}


def test_near_duplicates(staged):
    before, after = texts(staged[2]), set(texts(staged[3]))
    sets = {}
    for d, t in before.items():
        w = re.findall(r"[^ \t-\r]+", lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    root = lambda d: d if group[d] == d else root(group[d])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert after == {d for d in ids if root(d) == d}


def test_decontamination(spark, staged):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {" ".join(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    leaks = {d for d, t in texts(staged[3]).items() if any(f" {x} " in f" {' '.join(words(t))} " for x in windows)}
    assert set(texts(staged[4])) == set(texts(staged[3])) - leaks


def test_null_and_repeated_ids(spark):
    long = lambda name: " ".join(f"{name}{k}" for k in range(40))
    item = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 10)
    rows = [(None, long("a")), (None, long("b")), (None, long("b")), (1, long("c")), (2, long("c") + " more"), (2, long("d")), (2, long("d")), (3, long("e")), (3, long("e") + " more")]
    docs = spark.createDataFrame([(k, t, "en", "h", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_duplicates(spark, docs, DATA)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == 5
    assert set(got) - {(3, long("e")), (3, long("e") + " more")} == {(None, long("a")), (None, long("b")), (1, long("c")), (2, long("d"))}
    rows = [(None, long("a")), (None, f"{long('b')} {item}"), (1, item), (1, long("c")), (1, long("c"))]
    docs = spark.createDataFrame([(k, t, "en", "h", len(t)) for k, t in rows], docs.schema)
    out = corpus_pipeline.benchmark_decontamination(spark, docs, DATA)
    assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(1, long("c"))] * 2 + [(None, long("a"))]


def test_encoding(staged):
    import sentencepiece

    from planwright.llm.queries import TOKENIZERS

    model = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    before = texts(staged[4])
    out = {r.doc_id: r.ids for r in staged[5].where(F.col("round_trip")).collect()}
    assert out == {d: model.encode(t or "") for d, t in before.items()}
