"""Ways to get a DataFrame: tables, views, paths, literal and typed rows, script folders."""
