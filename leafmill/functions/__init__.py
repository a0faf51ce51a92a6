"""Column functions: personal data, addresses, files, metadata, text."""
