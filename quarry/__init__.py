"""quarry: document-corpus, retrieval, evaluation and curation operators on Spark DataFrames."""
