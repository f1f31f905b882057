"""Named queries over the input tables."""

from panelsmith.plans import properties, refreshing, sections, shaping, streams, testing, trailing  # noqa: F401  (they register)
from panelsmith.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
