"""All registered queries, in one import."""

from trolley.registry import (  # noqa: F401
    catalogue,
    evaluation,
    item_vectors,
    preparation,
    text_vectors,
)
from trolley.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
