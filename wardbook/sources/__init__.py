"""Reading and writing coded tables."""

from wardbook.sources.tables import (
    default_output_path,
    read_mapping,
    read_visits,
    schema_catalog,
    write_cleaned,
)

__all__ = ["default_output_path", "read_mapping", "read_visits", "schema_catalog", "write_cleaned"]
