"""Composed jobs: each catalog entry reads the driver tables (through the
capture templates) and returns one result DataFrame."""
