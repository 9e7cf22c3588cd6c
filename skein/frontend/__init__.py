"""The front end: source text to nodes, vertices and edges, one file at a time."""
