"""An extra beyond batch retrieval: rankings kept up to date over a stream of scores."""
