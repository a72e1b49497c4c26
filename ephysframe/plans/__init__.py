"""Query plans over the driver tables: role mapping, catalog, oracle SQL."""
