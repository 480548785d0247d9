"""The corpus pipeline: its stages, its run and its SQL (none). They are defined with the operators they call."""

from massweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
