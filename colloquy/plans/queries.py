"""All queries of the transcript operators."""

from . import basic, documents, ordered, relations, scalars  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
