"""Class and probability expressions: encode/decode, softmax, argmax, records.

Arrays are ``array<double>`` in class-index order.  With three classes the
arithmetic is written out over the elements, which Spark compiles; lambda
functions over the array would be interpreted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions import fixed


def label_map() -> Column:
    pairs = []
    for name, idx in fixed.LABEL_MAP.items():
        pairs += [F.lit(name), F.lit(idx)]
    return F.create_map(*pairs)


def label_encode(c: Column) -> Column:
    """Class name -> 0/1/2; anything else (case differs, unknown, null) -> null.

    A map lookup reads ``c`` once, so an expensive ``c`` is not repeated."""
    return F.try_element_at(label_map(), c).cast("int")


def class_names_array() -> Column:
    return F.array(*[F.lit(n) for n in fixed.CLASS_NAMES])


def label_decode(c: Column) -> Column:
    """0/1/2 -> class name; out of range -> null (no error under ANSI)."""
    return F.try_element_at(class_names_array(), c.cast("int") + 1)


def elements(z: Column) -> list[Column]:
    return [F.get(z, F.lit(k)) for k in range(len(fixed.CLASS_NAMES))]


def argmax(z: Column) -> Column:
    """Index of the largest element; ties go to the lowest index."""
    z0, z1, z2 = elements(z)
    best = F.when((z0 >= z1) & (z0 >= z2), 0).when(z1 >= z2, 1).otherwise(2)
    return F.when(z0.isNotNull() & z1.isNotNull() & z2.isNotNull(), best).cast("int")


def softmax(z: Column) -> Column:
    """Max-shifted softmax, stable for large logits; null stays null."""
    zs = elements(z)
    top = F.greatest(*zs)
    e = [F.exp(v - top) for v in zs]
    total = e[0] + e[1] + e[2]
    return F.when(total.isNotNull(), F.array(*[v / total for v in e]))


def class_prob_map(p: Column) -> Column:
    """Class name -> probability."""
    return F.map_from_arrays(class_names_array(), p)


def score_record(text: Column, p: Column) -> Column:
    """``struct(text, predicted_class, confidence, class_probabilities)``."""
    k = argmax(p)
    return F.struct(
        text.alias("text"),
        label_decode(k).alias("predicted_class"),
        F.element_at(p, k + 1).alias("confidence"),
        class_prob_map(p).alias("class_probabilities"),
    )
