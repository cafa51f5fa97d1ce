"""cobol of the engine."""
