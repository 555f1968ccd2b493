"""Column functions: sky geometry, time, photometry, tiles and text."""
