"""Column builders: calendar buckets, scalar normalisation and similarity."""
