"""What is read and what is kept: files of lines and JSON, the index on disk, a key-value table."""
