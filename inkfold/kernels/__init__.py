"""Pure Python kernels that Spark runs in Arrow batches."""
