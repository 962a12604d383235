"""Multi-model analytics on Spark: documents, time series, vectors, graphs, files and ledgers."""
