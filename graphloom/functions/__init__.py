"""graphloom.functions."""
