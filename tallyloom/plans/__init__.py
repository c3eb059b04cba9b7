"""The queries of the assessment and document engine, by name."""

from tallyloom.plans import assessment, documents, extra, library, more, pages, questions
from tallyloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assessment", "documents", "extra", "library", "more", "pages", "questions"]
