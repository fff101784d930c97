"""reelbook: catalogue matching, sync and reporting for match recordings, on Spark DataFrames."""
