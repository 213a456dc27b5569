"""Driver-side geometry and column expressions."""
