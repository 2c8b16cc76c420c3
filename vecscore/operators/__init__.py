"""DataFrame operators: search, clustering, layout, scoring, evaluation."""
