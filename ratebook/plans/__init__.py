"""Composed jobs: normalization, facility resolution, reports, warehouse tables and marts."""
