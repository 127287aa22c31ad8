"""Query plans composed of operators, and their SQL twins."""
