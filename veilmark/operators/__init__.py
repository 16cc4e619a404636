"""Dataset-level operators: detection, registry, rewriting, restoring, auditing."""
