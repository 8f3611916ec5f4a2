"""Registered queries: every operator run over the given tables, with its SQL restatement."""

from docloom.checks import q_audits, q_business, q_fields, q_grounding, q_jobs, q_pages, q_passages, q_quality, q_quotes, q_retrieval, q_sections_chunks  # noqa: F401
from docloom.checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["rt11_keyword_select"](spark, sf_dir)
