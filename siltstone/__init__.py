"""Analytics over corpora of code, pages and prose, and over their history, on Spark."""
