"""Column expressions, reports, validators and generators."""
