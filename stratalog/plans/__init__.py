"""Planning of compactions on file metadata."""
