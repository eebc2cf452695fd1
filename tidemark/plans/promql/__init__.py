"""PromQL: a parser, and a lowering of whole expressions to one Spark plan."""

from .evaluate import label_names, label_values, query_instant, query_range, series
from .parse import parse

__all__ = ["label_names", "label_values", "parse", "query_instant", "query_range", "series"]
