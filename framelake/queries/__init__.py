"""Registered queries over the driver's tables, each with the SQL that states it where SQL can."""

from . import factor, kernel, pixel, views  # noqa: F401  (views adds its queries to factor's)

QUERIES = {**pixel.QUERIES, **factor.QUERIES, **kernel.QUERIES}
ORACLE = {**pixel.ORACLE, **factor.ORACLE}
