"""Package part: operators over DataFrames."""
