"""Column builders: small linear algebra, projection, parsing of numbers."""
