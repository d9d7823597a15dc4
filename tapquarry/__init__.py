"""tapquarry: offline capture analytics and corpus operators on Spark."""
