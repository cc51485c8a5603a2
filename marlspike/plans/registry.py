"""All queries of the reference's operators: name -> function(spark, sf_dir), name -> SQL."""

from __future__ import annotations

from marlspike.plans import evaluation, ingest, online, retrieval

_PARTS = (retrieval, ingest, evaluation, online)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict = {k: s for p in _PARTS for k, s in p.ORACLE_SQL.items()}
