"""Registered queries over the driver's tables, each with its SQL counterpart."""

from pairsieve.plans.checks import code, documents, files, judge, measures, samples, streams

_PARTS = (documents, code, measures, samples, judge, files, streams)


def all_queries():
    return {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}


def all_oracles():
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
