"""The full catalogue: importing this module registers every query."""
from cytogrid.plans import graphs, expression, statistics, communication, raster, selection, typing, tables  # noqa: F401
from cytogrid.plans.registry import COVERS, ORACLE, QUERIES  # noqa: F401
