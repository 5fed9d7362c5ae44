"""Table access and checkpoints."""

from graphloom.sources.tables import cut, read, table_path

__all__ = ["cut", "read", "table_path"]
