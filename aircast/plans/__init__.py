"""Query plans: each registered query reads the driver tables through the
fixtures and composes library operators; each has a DuckDB oracle text
where the result is expressible in SQL."""
