"""Column expressions: they stay inside whole-stage code generation."""
