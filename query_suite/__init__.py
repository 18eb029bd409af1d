"""The registered queries, by area."""

from query_suite import analysis, class_models, closed_forms, features, files, long_sequences, modeling, reports, sequences, user_tables
from query_suite.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analysis", "class_models", "closed_forms", "features", "files", "long_sequences", "modeling", "reports", "sequences", "user_tables"]
