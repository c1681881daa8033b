"""SQL text handling, two-phase execution and the flow language."""
