"""Queries over the driver tables, by family, each with the SQL that must give the same rows where SQL can say it."""

from . import cleaning, columns, duplicates, filters, ingest, rules, signals, statistics, text

FAMILIES = (text, columns, duplicates, cleaning, filters, statistics, signals, ingest, rules)


def all_queries():
    return {name: fn for family in FAMILIES for name, fn in family.QUERIES.items()}


def all_oracles():
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
