"""Jobs and dashboard queries composed of operators."""
