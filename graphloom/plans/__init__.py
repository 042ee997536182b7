"""graphloom.plans."""
