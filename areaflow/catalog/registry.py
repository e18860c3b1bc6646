"""All registered queries; importing the query modules fills the registry."""

from areaflow.catalog import views
from areaflow.catalog import (  # noqa: F401
    column_queries, connectedness_queries, density_queries, dwell_queries, geo_queries, mobility_queries,
    network_queries, panel_queries, source_queries)


def queries():
    return dict(views.QUERIES)


def oracles():
    return views.oracles()
