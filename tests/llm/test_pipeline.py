"""The pipeline's stages against plain Python versions, each on what its predecessor kept."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terselake.llm import common, simhash, toxicity
from tests.llm.test_ops import plain_components, plain_fingerprint, plain_overlaps, plain_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "extra"]


def redacted(text):
    _, _, spans = plain_spans(text or "")
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in (s.split(":") for s in spans.split(",")):
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "on") for b in ("sa", "ri", "du", "ves", "an", "el")]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    docs, labels = [], []
    item = text(14)
    for k in range(240):
        t = text(r.randint(4, 90))
        if k % 6 == 0:
            t += " idiot " + text(3)
        if k % 17 == 0:
            t += ' password = "hunter2222" end'
        if k % 23 == 0:
            t += " " + item + " " + text(5)
        docs.append((k, t))
        labels.append((k, 1, int(k % 6 == 0)))
    docs += [(k + 300, docs[k][1]) for k in range(0, 60)] + [(400 + k, docs[7][1] + (f" {vocab[k]}" if k else "")) for k in range(5)] + [(7, docs[7][1]), (500, None), (501, ""), (None, text(30))]
    path = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = {}
    now = docs
    for name in list(stages)[:-1]:
        now = common.materialise(stages[name](spark, now, folder), name)
        assert now.columns == COLUMNS and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        step[name] = pairs(now)

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    want = sorted(((i, t) for i, t in pairs(docs) if scorer.score(t or "") < 0.5), key=repr)
    assert step["toxicity"] == want
    assert not any("idiot" in (t or "") for _, t in want) and len(want) > 200  # rejected ones go, clean ones stay

    prints = [plain_fingerprint(t) for _, t in want]
    groups = {}
    for (i, t), p, c in zip(want, prints, plain_components(prints), strict=True):
        groups.setdefault(c, []).append((i is None, i or 0, t))
    kept = sorted(((None if none else i, t) for none, i, t in (min(g, key=lambda m: (m[0], m[1])) for g in groups.values())), key=repr)
    assert step["near_dedup"] == kept and len(kept) < len(want) - 30

    clean = {r[0] for r in plain_overlaps(kept, [(1, spark.read.parquet(f"{folder}/benchmark.parquet").head().text)], 10) if r[2] == 0}
    assert step["decontamination"] == [(i, t) for i, t in kept if i in clean] and len(clean) < len(kept)

    assert step["secrets"] == sorted(((i, redacted(t)) for i, t in step["decontamination"]), key=repr)
    assert any("<assign>" in (t or "") for _, t in step["secrets"])
    assert now.where("text is not null and n_chars <> length(text)").count() == 0

    import tiktoken

    from terselake.llm import byte_bpe
    ranks = byte_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in step["secrets"]:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(out, key=repr)


def test_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_copies_of_one_text_leave_one_row(spark):
    df = spark.createDataFrame([(k % 50, "same words in every row of this table") for k in range(400)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(df.withColumn("id", F.lit("x"))).collect()] == [0]
