"""From raw documents to a sharded training mix: the stages of ``grafspan.llm.pipeline``."""

from grafspan.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
