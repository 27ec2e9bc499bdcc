"""Quality rules: a calibrated n-gram classifier with fixed thresholds.

Training draws at most ``sample_rows`` labelled rows; everything else is
scored. Whole texts are read in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmill.llm.linear import Model, sigmoid, train
from rillmill.llm.shared import sheltered

SAMPLE_ROWS = 4000
KEEP_AT, PREFER_AT = 0.5, 0.9


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_at: float = KEEP_AT, prefer_at: float = PREFER_AT) -> DataFrame:
    """(doc_id, probability, rule) for every row of docs.

    rule is ``prefer`` from prefer_at, ``keep`` from keep_at, else ``reject``;
    the probability is rounded to six places before it is compared. A null or blank text
    has nothing to keep: probability 0, ``reject``. Whole texts are scored, however long. Rows with null ids are scored like others,
    repeated rows give repeated rows and equal texts equal probabilities, a probability equal to a threshold passes it, an empty table gives an empty result,
    and without labels of both classes, or with fewer than ``linear.LEAST_ROWS`` of them, every other row gets the smoothed base rate.
    Columns beside doc_id and text are not read, whatever their names.
    """
    model: Model = train(docs, labels, "quality", sample_rows)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.a, model.b, model.base))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            p = np.round(sigmoid(m.log_odds(texts)), 6)
            p[[not t or t.isspace() for t in texts]] = 0.0
            rule = np.where(p >= prefer_at, "prefer", np.where(p >= keep_at, "keep", "reject"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(rule.tolist(), pa.string())], ["doc_id", "probability", "rule"])

    return sheltered(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, probability double, rule string")


def quality_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows that the thresholds let pass, with probability and rule; see ``score_quality``."""
    return score_quality(docs, labels, **params).where(F.col("rule") != "reject")
