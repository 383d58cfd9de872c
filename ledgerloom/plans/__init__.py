"""Jobs composed of operators, and the catalogue of checked queries."""
