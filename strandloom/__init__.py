"""strandloom: sequence alignment and consensus as Spark DataFrame jobs."""

__version__ = "0.1.0"
