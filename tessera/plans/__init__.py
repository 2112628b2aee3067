"""Queries by name, and their SQL."""

from . import certify, files, grid, more, pairs, ranks, texts, training, vectors  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
