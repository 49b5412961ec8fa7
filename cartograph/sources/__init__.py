"""File discovery, text reading and the Parquet store."""
