"""fragsql: a Spark-first engine for two-phase SQL over key-aware fragmented tables."""

__version__ = "0.1.0"
