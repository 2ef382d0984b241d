"""Query catalogue: named plans over the operators."""
