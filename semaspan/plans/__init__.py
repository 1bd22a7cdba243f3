"""Plan building blocks shared by the operators: lookups, ordered passes, settled tables."""
