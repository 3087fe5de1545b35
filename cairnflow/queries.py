"""Every query outside the training-data subpackage, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from .plans import business, knowledge, platform, records, signals, streams

QUERIES: dict = business.QUERIES | signals.QUERIES | knowledge.QUERIES | records.QUERIES | platform.QUERIES | streams.QUERIES
ORACLES: dict[str, str] = business.ORACLES | signals.ORACLES | knowledge.ORACLES | records.ORACLES | platform.ORACLES | streams.ORACLES
