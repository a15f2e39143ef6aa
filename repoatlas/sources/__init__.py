"""File readers and writers around the catalog."""
