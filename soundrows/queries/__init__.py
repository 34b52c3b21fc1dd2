"""Registered queries over the given tables, each with its SQL counterpart."""

from soundrows.queries import (  # noqa: F401  (registration)
    clinical_queries,
    exchange_queries,
    history_queries,
    report_queries,
    rule_queries,
)
from soundrows.queries.register import ORACLES, QUERIES  # noqa: F401
