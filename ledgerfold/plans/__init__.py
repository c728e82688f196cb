"""Query catalogue: every operator bound to the test tables, plus its SQL oracle.

``catalog.queries()`` maps a name to ``fn(spark, sf_dir) -> DataFrame``;
``catalog.oracle_sql()`` maps the same name to DuckDB SQL over the raw
tables. Float outputs are rounded to 6 digits on both sides.
"""
