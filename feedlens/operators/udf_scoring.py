"""M7 — a pluggable scorer run on Arrow batches (``mapInPandas``).

The scorer is any function from a batch of class sums (a float array of three
columns) to a batch of probabilities.  The sums come from the relational join
of ``weight_sums``, so the scorer sees a fixed-width vector per text and the
model may have any number of weights; nothing of it is gathered.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from feedlens.functions import probs as P
from feedlens.operators.scoring import attach, class_sums

# The task's function travels whole: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def softmax(z: np.ndarray) -> np.ndarray:
    """The default scorer."""
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_udf(docs: DataFrame, weights: DataFrame, key="doc_id", text: str = "text",
              keep: tuple[str, ...] = (), scorer=softmax, unique: bool = False) -> DataFrame:
    """``scoring.score_docs`` with the probabilities of ``scorer``; a text that
    has no sums (null) is not passed to it and keeps null scores."""
    ks = (key,) if isinstance(key, str) else tuple(key)
    base = class_sums(weights, docs, ks, text, unique).select(
        *ks, "_id", "_ok", *[F.get("z", F.lit(k)).alias(f"z{k}") for k in range(3)])
    schema = StructType([*base.schema.fields, *[StructField(f"p{k}", DoubleType()) for k in range(3)]])

    def run(batches):
        for pdf in batches:
            z = pdf[["z0", "z1", "z2"]].to_numpy(float)
            ok = ~np.isnan(z).any(axis=1)
            p = np.full(z.shape, np.nan)
            if ok.any():
                p[ok] = scorer(z[ok])
            yield pd.concat([pdf, pd.DataFrame(p, columns=["p0", "p1", "p2"], index=pdf.index)], axis=1)

    out = attach(docs, base.mapInPandas(run, schema), ks, text, keep, unique=unique)
    have = F.col("p0").isNotNull() & ~F.isnan("p0")
    p = F.when(have, F.array("p0", "p1", "p2"))
    return (out.withColumn("z", F.when(have, F.array("z0", "z1", "z2"))).withColumn("p", p)
               .withColumn("pred", P.argmax(F.col("p"))).drop("z0", "z1", "z2", "p0", "p1", "p2")
               .withColumn("predicted_class", P.label_decode(F.col("pred")))
               .withColumn("confidence", F.element_at("p", F.col("pred") + 1)))
