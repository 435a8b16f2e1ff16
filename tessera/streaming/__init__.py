"""Row-wise operators on streams.

Scan, filter, computed column and projection hold no state, so the same
functions take a streaming DataFrame.  There is no stateful streaming operator.
"""

from tessera.operators.relational import compute, project, where

__all__ = ["compute", "project", "where"]
