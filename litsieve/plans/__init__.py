"""The query catalogue and phase pipelines."""
