"""Table maintenance and relational helpers."""
