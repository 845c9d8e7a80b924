"""Reports and media as tables of rows or of file contents, and their writers."""
