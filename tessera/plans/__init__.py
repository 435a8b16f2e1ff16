from tessera.plans.builder import Plan
from tessera.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "Plan"]
