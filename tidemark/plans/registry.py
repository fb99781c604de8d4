"""All registered reference queries and their oracle SQL."""

from __future__ import annotations

from . import events, records

QUERIES: dict = {**events.Q, **records.Q}
ORACLES: dict[str, str] = {**events.O, **records.O}
