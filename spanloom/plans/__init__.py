"""All registered queries."""

from spanloom.plans import annotations, checks, files, learning, lexicon, stores, texts  # noqa: F401
from spanloom.plans.registry import ORACLES, PLANS  # noqa: F401
