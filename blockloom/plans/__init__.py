"""SQL front end and the incremental planner."""
