"""The registered queries of this folder and of the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quarrymind.llm import alignment, codes, licenses, media, merkle, pages, pieces, private, quality, shards, simhash, substrings, tiling

MODULES = [simhash, licenses, pieces, private, substrings, codes, media, tiling, quality, pages, merkle, alignment, shards]
QUERIES = {name: fn for module in MODULES for name, fn in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
