"""Registered queries of the vocabulary engine and their SQL twins."""

from __future__ import annotations

from .plans.queries import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
