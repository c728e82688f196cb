"""DataFrame -> DataFrame operators (use with ``df.transform``)."""
