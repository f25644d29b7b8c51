"""Query operators over DataFrames of vectors."""
