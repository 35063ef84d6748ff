"""Operators that prepare text corpora for training, with their registered queries."""

from gridsight.llm import (  # noqa: F401  (importing registers the queries)
    centroids, html_text, lexical, licences, mixing, near_dup, packing, quality_model,
    quality_rules, secret_scan, sharding, signature_join, topk)
from gridsight.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
