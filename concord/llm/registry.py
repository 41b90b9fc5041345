"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

import corpus_pipeline
from concord.llm import queries as q
from concord.llm import sql

QUERIES = {name: getattr(q, name) for name in q.__all__} | {"pipeline": corpus_pipeline.run}
ORACLES = dict(sql.ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
