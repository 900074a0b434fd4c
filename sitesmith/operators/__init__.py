"""DataFrame operators: joins, points, meshes, quotes, store semantics."""
