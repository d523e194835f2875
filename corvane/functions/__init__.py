"""Column functions for text, labels, arrays, geometry and metrics."""
