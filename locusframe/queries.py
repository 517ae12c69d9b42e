"""The catalogue of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from locusframe.catalogue import arrays, campaign, families, loci, rules, search, sequences, statistics

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (sequences, search, loci, statistics, rules, families, arrays, campaign):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
