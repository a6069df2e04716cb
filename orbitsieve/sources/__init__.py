"""Reading and writing catalogs."""
