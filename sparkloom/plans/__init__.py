"""Registered queries and their SQL."""

from sparkloom.plans import conversations, metrics, procurement, sequential, state, stored, text, vectors  # noqa: F401
from sparkloom.plans._registry import ORACLE_SQL, QUERIES  # noqa: F401
