"""Shop and experiment analytics as Spark jobs, for all tenants at once."""
