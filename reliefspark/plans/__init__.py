"""Registered queries over the input tables, by subject."""

from importlib import import_module

SUBJECTS = ("point_queries", "relief_queries", "catalogue_queries", "tile_queries", "vector_queries", "state_queries", "source_queries")


def load() -> None:
    """Import every subject so that its queries are registered."""
    for subject in SUBJECTS:
        import_module(f"{__name__}.{subject}")
