"""Functions on array columns: one array for each sample and variable."""
