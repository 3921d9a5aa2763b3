"""Registered queries by group; each module fills the registry when it is imported."""

from . import anchoring, collab, explain, label, landing, more, papers, relational, retrieval, rules, skills, stats, steps, texts, training  # noqa: F401
