"""Registered queries and their SQL twins, by family."""

from earmark.checks import evaluation, fusion, manifest, plans, project, signal, vectors

QUERIES = {}
ORACLES = {}
for family in (vectors, fusion, evaluation, manifest, plans, signal, project):
    QUERIES.update(family.QUERIES)
    ORACLES.update(family.ORACLES)
