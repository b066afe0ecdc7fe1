"""Part of the Larkspur engine."""
