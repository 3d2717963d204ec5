"""Structured Streaming: incremental corpus updates and stateful folds."""
