"""All registered queries of the library."""

from . import attribution_queries, delegation_queries, experiment_queries, fold_queries, log_queries, measure_queries, outcome_queries, place_queries, request_queries, source_queries, text_queries, worker_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "delegation_queries", "experiment_queries", "attribution_queries", "fold_queries", "log_queries", "measure_queries", "outcome_queries", "place_queries", "request_queries", "source_queries", "text_queries", "worker_queries"]
