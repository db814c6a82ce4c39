"""Relational building blocks: detector catalog, detection, overlap resolution, replacement, taxonomy."""
