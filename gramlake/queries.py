"""Queries of the library's own operators, and their SQL: gathered from the modules that define them."""

from __future__ import annotations

from gramlake.functions import casts, numerics, records, scalars
from gramlake.operators import additive, advanced, bounded, constraints, diagnostics, edits, elements, joins, layers, linear, mesh, models, nets, pairs, sampling, scalable, spatial, tables
from gramlake.plans import modelling, service, tools
from gramlake.sources import workbooks

MODULES = (tables, linear, diagnostics, joins, scalars, sampling, models, advanced, mesh, service, casts, edits, numerics, records, workbooks, spatial, additive, elements, modelling, constraints, tools, bounded, pairs, layers, scalable, nets)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: q for m in MODULES for k, q in m.SQL.items()}
