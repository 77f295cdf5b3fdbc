"""Operators over DataFrames: relational analytics, deduplication, ranking, chunking, chats."""
