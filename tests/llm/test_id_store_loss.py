"""A store that lost a part fails when read."""

import os
import random
from urllib.parse import urlparse

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terselake.llm import id_store


@pytest.mark.parametrize("manifest", [True, False])
def test_a_lost_shard_is_noticed(spark, monkeypatch, manifest):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["Thor", "house", "river", "green"]) for _ in range(n))
    long = text(3000)
    docs = spark.createDataFrame([(0, long), *((k, text(200)) for k in range(1, 60)), (60, long)], "doc_id long, text string")
    store = id_store.write(docs, public_tokenizers.path("word_bpe_49k.json"), shard_tokens=4000)
    assert id_store.checksums(spark, store).count() == 61
    first = spark.read.parquet(store.documents).where("doc_id = 0").select(F.input_file_name()).head()[0]
    os.remove(urlparse(first).path)
    if not manifest:  # the lent chunks alone
        monkeypatch.setattr(id_store, "verify_manifest", lambda spark, store: True)
    with pytest.raises(Exception, match="differs from its manifest" if manifest else "a borrowed chunk is missing"):
        id_store.checksums(spark, store).collect()
