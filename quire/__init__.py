"""quire: corpus analytics over tables of papers, pages and answers, written as Spark DataFrames."""
