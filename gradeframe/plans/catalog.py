"""All registered queries."""

from gradeframe.plans import exams, files, parsing, streams, summaries, texts, upkeep, vectors  # noqa: F401
from gradeframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
