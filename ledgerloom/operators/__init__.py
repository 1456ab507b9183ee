"""The operators, one module per area of the library."""
