"""End-to-end compositions and the registry of checked queries."""
