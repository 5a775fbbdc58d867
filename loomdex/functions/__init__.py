"""Part of loomdex."""
