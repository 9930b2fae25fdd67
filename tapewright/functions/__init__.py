"""Column functions: no shuffle, whole-stage code generation."""
