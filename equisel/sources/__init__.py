"""Sources and sinks: table readers/writers, keyed record stores, derived views."""

from equisel.sources.tables import read_table, table
from equisel.sources import views

__all__ = ["read_table", "table", "views"]
