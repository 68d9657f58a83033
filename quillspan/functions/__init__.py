"""Column functions: text forms, numbers of chapters, keys, identity from content."""
