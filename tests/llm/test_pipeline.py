"""The pipeline's stages, each against what its operator says of the stage's own input."""

import re

import numpy as np
import pandas as pd

import corpus_pipeline
from attest.llm import langid, neardup

from .test_operators import SCHEMA, rows


def test_stages_in_order(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near", "secrets", "mix", "pack"]
    docs = spark.createDataFrame(rows(), SCHEMA)
    seen = [docs.toPandas()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "").cache()
        if k < 4:
            assert out.columns == docs.columns, name
        seen.append(out.toPandas())
        docs = out
    start, known, single, masked, mixed, packed = seen

    model = langid.train(spark.createDataFrame(rows(), SCHEMA))
    text = start["text"].map(lambda t: t if isinstance(t, str) else "")
    (_, prior, log_p), = model
    best, _, own, most, mass = langid.scored(text.tolist(), prior, log_p.value)
    assert len(known) == sum(b >= 0 and np.exp(o - m) / z >= langid.LEAST_SCORE for b, o, m, z in zip(best, own, most, mass, strict=True))

    w = neardup.weighted(single["text"].tolist(), neardup.idf_table(spark.createDataFrame(known[["text"]])))
    assert max(neardup.similarity(w[i], w[j]) for i in range(len(w)) for j in range(i) if len(w[i][0]) and len(w[j][0])) < neardup.THRESHOLD
    assert single["text"].is_unique and set(single["text"]) <= set(known["text"])

    assert len(masked) == len(single)
    assert not masked["text"].str.contains("f33e61083db5dbdf").any()
    plain = ~masked["text"].str.contains("<secret>")
    assert set(masked[plain]["text"]) <= set(single["text"])

    assert set(mixed["text"]) <= set(masked["text"]) and mixed.groupby("text").size().max() <= 2
    n = mixed["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).sum()
    assert packed["piece_size"].sum() == n
    assert isinstance(packed, pd.DataFrame) and (packed.groupby("bin_id")["piece_size"].sum() <= 2048).all()


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
