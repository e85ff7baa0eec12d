"""evenflow -- group fairness of ordered data on Spark: prepare, monitor, repair, evaluate."""
