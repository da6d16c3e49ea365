"""Review tables derived from the test data, their SQL oracles and the query list."""
