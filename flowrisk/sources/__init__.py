"""Input relations: driver tables, literal registries, landed JSON series, sinks."""
