"""Part of hirelake."""
