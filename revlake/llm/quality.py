"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revlake.llm.ftrl import Features, Model, fit

SPEC = Features(order=2, skip=2, shapes=True)
#: Labelled rows the model is fitted on, at most.
SAMPLE = 6000
#: Documents at or above are good.
THRESHOLD = 0.3


def quality_model(docs: DataFrame, labels: DataFrame, fold, limit: int = SAMPLE) -> Model:
    return fit(docs, labels, "quality", fold, SPEC, limit)
