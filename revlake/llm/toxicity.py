"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revlake.llm.ftrl import Features, Model, fit

SPEC = Features(order=2, skip=1, unit=False)
#: Rates of the FTRL updates; an n-gram needs about this much evidence (l1) to get a weight at all.
RATES = {"alpha": 3.0, "l1": 2.5, "l2": 0.001, "epochs": 16}
#: Labelled rows the model is fitted on, at most.
SAMPLE = 12000
#: Documents at or above are toxic.
THRESHOLD = 0.7


def toxicity_model(docs: DataFrame, labels: DataFrame, fold, limit: int = SAMPLE) -> Model:
    return fit(docs, labels, "toxic", fold, SPEC, limit, **RATES)
