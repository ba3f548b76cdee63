"""Jobs that compare revisions of documents across a whole corpus."""
