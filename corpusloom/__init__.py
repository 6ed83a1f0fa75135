"""corpusloom: Spark jobs over document corpora (DataFrame in, DataFrame out)."""
