"""Column functions on sequences, paths and edits, and the numpy kernels that run inside tasks."""
