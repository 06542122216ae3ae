"""Importing this module registers every query of the library itself."""

from evidentia.plans import catalog, evidence, identity, log, numeric, research, retrieval  # noqa: F401
from evidentia.plans.base import ORACLES, QUERIES  # noqa: F401
