"""Content-graph analytics on Spark: blobs, chunks, directories, links and roots as DataFrames."""
