"""millrace: record mirrors, text derivation and corpus curation as Spark plans."""
