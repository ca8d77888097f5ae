"""Two-class scores from logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.columns import AI, HUMAN, LABEL_NAMES


def softmax_of(own: Column, other: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(other - own))


def prediction(logit_human: Column, logit_ai: Column) -> Column:
    """Class of the larger logit; a tie goes to human."""
    return F.when(logit_ai > logit_human, AI).otherwise(HUMAN)


def cross_entropy(label: Column, logit_human: Column, logit_ai: Column) -> Column:
    """Loss of the true class, in the form that cannot overflow."""
    gap = F.when(label == AI, logit_human - logit_ai).otherwise(logit_ai - logit_human)
    return F.greatest(gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))


def label_name(label: Column) -> Column:
    return F.when(label == HUMAN, LABEL_NAMES[HUMAN]).when(label == AI, LABEL_NAMES[AI])
