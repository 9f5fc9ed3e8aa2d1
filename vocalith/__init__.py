"""vocalith: speech and text corpus analytics on Spark DataFrames."""
