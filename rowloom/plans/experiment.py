"""Stored similarity lists against truth, and against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowloom.operators.evaluate import kendall, kendall_summary, prf
from rowloom.operators.match import beyond_source, flat_list, predicted_pairs, truth_pairs


def list_against_truth(similarity: DataFrame, truth: DataFrame, n_first: int, digits: int) -> DataFrame:
    """Precision, recall and F1 of a stored list (``id, similarity``)."""
    return prf(predicted_pairs(flat_list(similarity), n_first, digits), truth_pairs(truth))


def list_against_list(stream: DataFrame, batch: DataFrame, source_num: int, threshold: float = 0.5) -> DataFrame:
    """Rank agreement of two stored lists for ids beyond ``source_num``."""
    a, b = [beyond_source(flat_list(s), source_num) for s in (stream, batch)]
    return kendall_summary(kendall(a, b), threshold)
