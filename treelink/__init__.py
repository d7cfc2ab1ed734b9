"""treelink: link prediction on large edge tables, with Spark DataFrames."""
