"""The pipeline's stages against plain versions, stage by stage, over a table of hard cases too."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestone.llm import importance, language, mixing, packing, queries, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GOOD = "the river runs past the old mill and the children play on its banks until the evening comes"
HARD = [
    (1, GOOD, "en", "src0", 5),
    (1, GOOD, "en", "src0", 5),
    (2, None, None, None, None),
    (None, "der schnelle braune fuchs springt nicht über den faulen hund", "de", "src1", 1),
    (3, "", "en", "src1", 0),
    (4, " \n " * 300, "en", "src2", 0),
    (5, " ".join(f"word{i % 977}" for i in range(20_000)), "en", "src9", 9),
    (6, "!!! ???", "de", None, 9),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_language(docs, net):
    text = pa.array([r[1] for r in docs])
    p = language.score(net, text)
    return [r for r, x in zip(docs, p, strict=True) if not np.isnan(x[0]) and round(float(x.max()), 6) >= language.LEAST]


def plain_quality(spark, docs, df, labels):
    model = importance.fit(df, labels)
    if model is None:
        return docs
    w = model.log_weights(pa.array([r[1] for r in docs]))
    hashes = df.select(importance._hash(), "doc_id", "text").collect()
    noise = {(r["doc_id"], r["text"]): r["_h"] for r in hashes}
    keys = importance._keys(model, pa.array([noise[r[0], r[1]] for r in docs]), pa.array([r[1] for r in docs]), importance.SEED)[1]
    k = round(float(np.sum(np.round(np.minimum(1, model.share * np.exp(np.minimum(w, 50))) * 1e6))) / 1e6)
    if k <= 0:
        return []
    least = sorted(keys, reverse=True)[min(k, len(keys)) - 1]
    return [r for r, x in zip(docs, keys, strict=True) if x >= least or k >= len(keys)]


def plain_dedup(docs):
    """One row of each group: the least doc_id (none last), of its group's fingerprints the least."""
    fp = simhash.fingerprints(pa.array([r[1] for r in docs]))
    near = simhash._near(fp, fp)
    root = np.arange(len(docs))
    while True:
        least = np.where(near, root[None, :], len(docs)).min(axis=1) if len(docs) else root
        if (least == root).all():
            break
        root = least
    out = []
    for g in set(root.tolist()):
        own = [i for i in range(len(docs)) if root[i] == g]
        best = min(own, key=lambda i: (docs[i][0] is None, docs[i][0] or 0, simhash._binary(fp[i : i + 1]).to_pylist()[0]))
        out.append(docs[best])
    return out


def plain_mix(docs):
    key = lambda r: (hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    size = lambda r: len((r[1] or "").split())
    spent, timed = {}, []
    for r in sorted(docs, key=key):
        spent[r[3]] = spent.get(r[3], 0) + size(r)
        timed.append((spent[r[3]] / mixing.TARGET.get(r[3], mixing.OTHERS), r[3] is not None, r[3] or "", key(r), r))
    budget, total, out = int(sum(map(size, docs)) * mixing.SHARE), 0, []
    for *_, r in sorted(timed, key=lambda x: x[:4]):
        total += size(r)
        if total > budget:
            break
        out.append(r)
    return out


def plain_pack(docs, context=packing.CONTEXT):
    import re

    out = []
    for r in docs:
        w = re.findall(packing.TOKEN, r[1] or "")
        n, start, k = len(w), 0, 0
        while start < n:
            size = min(context, 1 << (n - start).bit_length() - 1)
            out.append((r[0], k, start, size, "".join(w[start : start + size])))
            start, k = start + size, k + 1
    return out


@pytest.mark.parametrize("hard", [False, True])
def test_stages_against_plain_versions(spark, hard):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.createDataFrame(HARD, SCHEMA) if hard else spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = [tuple(r) for r in docs.collect()]
    net = language.train(docs)
    out = stages["language_id"](spark, docs, SF)
    want = plain_language(now, net)
    assert rows(out) == sorted(want, key=repr)

    now, df = want, spark.createDataFrame(want, SCHEMA)
    out = stages["quality_classifier"](spark, df, SF)
    want = plain_quality(spark, now, df, labels)
    assert rows(out) == sorted(want, key=repr)

    df = spark.createDataFrame(want, SCHEMA)
    out = stages["simhash_near_dedup"](spark, df, SF)
    want = plain_dedup(want)
    assert rows(out) == sorted(want, key=repr)

    df = spark.createDataFrame(want, SCHEMA)
    out = stages["mixing"](spark, df, SF)
    want = plain_mix(want)
    assert [tuple(r) for r in out.collect()] == want

    df = spark.createDataFrame(want, SCHEMA)
    assert rows(stages["packing"](spark, df, SF)) == sorted(plain_pack(want), key=repr)


def test_an_empty_table_goes_through_all_stages(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_runs_whole_and_leaves_its_last_stage_only(spark):
    import os

    before = set(os.listdir(corpus_pipeline.checkpoint_dir(spark)))
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "text"] and out.count() > 0
    made = [d for d in set(os.listdir(corpus_pipeline.checkpoint_dir(spark))) - before if d.startswith("pipeline-")]
    assert [os.listdir(f"{corpus_pipeline.checkpoint_dir(spark)}/{d}") for d in made] == [["4-packing"]]


def test_ten_queries():
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 11))
