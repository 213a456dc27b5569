"""Plan building blocks: grids, staging, spatial joins, ranks and graphs."""
