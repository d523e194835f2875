"""The registered queries, one module for each family, with their SQL twins."""
