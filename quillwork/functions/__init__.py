"""Package part: column expressions."""
