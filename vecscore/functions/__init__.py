"""Column expressions: distances, clamping, quantisation, features, the pseudo-random sequence."""
