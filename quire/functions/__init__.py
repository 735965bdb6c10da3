"""Part of the quire engine."""
