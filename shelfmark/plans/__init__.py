"""Mapping of the driver tables to corpus frames, the query catalogue and its SQL twins."""
