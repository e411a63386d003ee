"""Column expressions: ``Column -> Column``."""
