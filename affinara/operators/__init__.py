"""DataFrame operators: catalog, features, ranking, neighbours, LSH, evaluation, profile."""
