"""Input readers: delimited files and the driver's Parquet tables."""
