"""Every query of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from matloom.queries import graphs, kernels, matrices, statistics, streams  # noqa: F401
from matloom.queries.base import ORACLES, QUERIES  # noqa: F401
