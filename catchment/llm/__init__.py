"""Training-data pipeline operators: text hygiene, dedup, scoring, archives, sharding."""
