"""Reading requests, dictionaries and samples, and writing results."""
