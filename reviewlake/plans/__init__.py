"""Named queries over the test tables (``QUERIES``) and their oracles (``ORACLE``).

Importing this package registers every query module.
"""

from reviewlake.plans import catalog, ingest, profile, sentiment, stream, text  # noqa: F401,E501
from reviewlake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
