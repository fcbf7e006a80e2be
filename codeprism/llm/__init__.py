"""Training-data operators. Nothing outside this subpackage imports it; delete the folder and the rest still works."""
