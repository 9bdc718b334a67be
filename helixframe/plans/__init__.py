"""Multi-step flows composed from the operators."""
