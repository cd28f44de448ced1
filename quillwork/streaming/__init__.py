"""Package part: incremental twins of batch operators."""
