"""Sources: Parquet/CSV/JSON readers, semantic column mapping, table bindings."""
