"""Reports: each takes the fact and returns one result frame."""
