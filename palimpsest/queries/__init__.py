"""Registered queries: importing the modules fills the registry."""

from . import changes, relational, scalars, scans, tables  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
