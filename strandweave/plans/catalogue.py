"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from strandweave.plans import alignments, evidence, formats, haplotypes, methylation, problems, states, tools, variants_and_sites

MODULES = (problems, methylation, alignments, states, haplotypes, variants_and_sites, evidence, tools, formats)
FLAGSHIP = "pair_tests"

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
