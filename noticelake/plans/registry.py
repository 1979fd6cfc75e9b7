"""All registered queries with their SQL for the other engine."""

from __future__ import annotations

from . import catalog, formats, learning, places, records, spatial, streams, texts, webpages  # noqa: F401
from .register import QUERIES, SQL
from .views import Tables


def flagship(spark, sf_dir):
    return records.flagship(Tables(spark, sf_dir))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
