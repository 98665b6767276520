"""Column functions over script text and dataset names."""
