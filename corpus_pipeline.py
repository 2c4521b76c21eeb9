"""Corpus pipeline over documents: STAGES in order, each written by the caller and read again by the next."""

from __future__ import annotations

from perioda.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
