"""graphloom: versioned software-graph analytics and training-data preparation on Spark."""
