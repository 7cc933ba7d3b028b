"""Sources and sinks: delimited text, sequences, order and class tables, matrices, keyed Parquet, and a block format."""
