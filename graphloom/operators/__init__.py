"""graphloom.operators."""
