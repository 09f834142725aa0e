"""Names of all queries and their SQL."""

from __future__ import annotations

from bindwell.plans import dashboards, devices, ingest, lookups, network, profiles, signals, state, stored, views

QUERIES: dict = {**state.QUERIES, **network.QUERIES, **lookups.QUERIES, **dashboards.QUERIES, **devices.QUERIES, **profiles.QUERIES, **signals.QUERIES, **views.QUERIES, **ingest.QUERIES, **stored.QUERIES}
ORACLES: dict = {**state.ORACLES, **network.ORACLES, **lookups.ORACLES, **dashboards.ORACLES, **devices.ORACLES, **profiles.ORACLES, **signals.ORACLES, **views.ORACLES, **ingest.ORACLES, **stored.ORACLES}
