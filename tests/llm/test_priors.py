"""Priors of the languages are those of all labelled documents, however few are sampled."""

import numpy as np

from tidemark.llm import langid


def test_priors_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 40)
    rows = [(k, f"one two {k}", "en") for k in range(300)] + [(1000 + k, f"un deux {k}", "fr") for k in range(100)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"] and np.allclose(np.exp(model.log_prior), [0.75, 0.25])
