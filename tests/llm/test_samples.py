"""Training samples stay bounded, and the same, when an id comes a thousand times."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import common, language, quality
from tests.conftest import SF


def test_language_sample_with_one_id_a_thousand_times(spark):
    common.ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.where("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").limit(1)
    many = docs.unionByName(again.crossJoin(spark.range(1000).select()).select(docs.columns))
    assert many.count() == docs.count() + 1000
    assert language._sample(many, 60).count() == language._sample(docs, 60).count() == 60
    one, other = (sorted(map(tuple, language._sample(d, 60).collect())) for d in (many, docs))
    assert one == other
    # the ids of least hash of each language, in turn
    ids = {}
    for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect():
        ids.setdefault(r.lang, []).append((r.h, r.doc_id))
    turns = sorted((i, lang, doc) for lang, held in ids.items() for i, (_, doc) in enumerate(sorted(held)))
    assert sorted(r[0] for r in other) == sorted(doc for _, _, doc in turns[:60])


def test_quality_sample_with_one_id_a_thousand_times(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    again = docs.join(labels.select("doc_id"), "doc_id").orderBy("doc_id").limit(1)
    many = docs.unionByName(again.crossJoin(spark.range(1000).select()).select(docs.columns))
    assert np.array_equal(quality.train(many, labels), quality.train(docs, labels))
