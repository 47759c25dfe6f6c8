"""Driver-facing queries over the given tables and the SQL they are compared with."""
from . import core, history, runs, sources, sql_surface, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
