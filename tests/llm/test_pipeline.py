"""The pipeline's stages, one after the other, against plain versions of each."""

import collections
import re

import corpus_pipeline
from test_neardup import brute as groups_of
from test_packing import check as check_pieces
from test_substrings import brute as cut_of

FOLDER = "/root/testdata/sf0.001"


def hit_share(text, windows):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hit = set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
    return len(hit), len(words)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 30").withColumn("doc_id", docs["doc_id"] + 1000))
    docs = docs.unionByName(docs.filter("doc_id < 3"))  # repeated rows
    columns, made = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        made.append({r["doc_id"]: r for r in docs.collect()} if name != "mixture_packing" else docs.collect())
        assert name == "mixture_packing" or docs.columns == columns
    good, single, cut, clean, pieces = made

    assert all(len(r["text"].split()) >= 40 for r in good.values()) and len(good) > 100
    groups = groups_of([(i, r["text"]) for i, r in good.items()], 5)
    assert set(single) == {i for i, g in groups.items() if g[2]}

    ids = sorted(single)
    want = dict(zip(ids, cut_of([single[i]["text"] for i in ids], 35)))
    assert set(cut) == {i for i in ids if want[i][1] < want[i][0]}
    for i, r in cut.items():
        assert r["text"].encode().split() == [w.encode() for w in want[i][2]]
        assert r["n_chars"] == len(r["text"]) and r["source"] == single[i]["source"]

    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i:i + 13])].add(r["item_id"])
    shares = {i: hit_share(r["text"], windows) for i, r in cut.items()}
    assert set(clean) == {i for i, (h, n) in shares.items() if not (h and 20 * h >= n)}
    check_pieces(pieces, [(i, r["text"]) for i, r in clean.items()], 4096)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert "sequence_id" in out.columns and out.count() > 0
