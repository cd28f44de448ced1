"""Package part: readers and writers."""
