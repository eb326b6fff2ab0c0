"""quarry: document-corpus analytics as Spark jobs (DataFrame in, DataFrame out)."""
