"""All registered queries; importing the modules registers them."""

from . import anomaly, core, corroboration, evaluation, flows, fundflow, geo, graphs, learning, measures, more, readside, records, review, stores, streams
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "anomaly", "core", "corroboration", "evaluation", "flows", "fundflow", "geo", "graphs", "learning", "measures", "more", "readside", "records", "review", "stores", "streams"]
