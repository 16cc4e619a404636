"""Column expressions: patterns, scalar helpers, spans and text rewriting."""
