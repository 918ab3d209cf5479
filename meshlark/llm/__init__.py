"""Training-data operators: joins, scoring, filters and output formats for text corpora."""
