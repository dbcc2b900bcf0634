"""Operators for preparing language-model training data, one module each, with their registered queries."""

import sys
from importlib import import_module

from pyspark import cloudpickle

# Functions of this package travel to executors whole, so it needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPERATORS = (
    "decontamination", "mixing", "licences", "language_id", "toxicity", "token_output", "quality_rules", "html_text",
    "url_filter", "simhash", "spelling", "centroids", "lm_score",
)


def load_queries() -> tuple[dict, dict]:
    """Queries and SQL twins of all operators, keyed by query name."""
    queries, sqls = {}, {}
    for name in OPERATORS:
        module = import_module(f"ledgerspark.llm.{name}")
        queries.update(module.QUERIES)
        sqls.update(module.ORACLE_SQL)
    return queries, sqls
