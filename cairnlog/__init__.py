"""Log time-series search on Spark: label-set streams, boolean term queries, step counts, blocks and streaming ingest."""
