"""Registered queries; importing this package fills the registry."""

from tabularium.plans import (  # noqa: F401
    analytics, documents, governance, movement, nested, relational, synthesis, tabular,
)
from tabularium.plans.registry import REGISTRY  # noqa: F401
