"""Named queries over the test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Iterator


def all_catalogs() -> Iterator:
    from tapewright.plans import choice_queries, interval_queries, more_queries, periods, rule_queries, sequence_queries, stat_queries, text_queries, time_queries, timeline_queries

    yield periods.CATALOG
    yield rule_queries.CATALOG
    yield time_queries.CATALOG
    yield interval_queries.CATALOG
    yield text_queries.CATALOG
    yield stat_queries.CATALOG
    yield sequence_queries.CATALOG
    yield timeline_queries.CATALOG
    yield choice_queries.CATALOG
    yield more_queries.CATALOG
