"""Conversation-text analytics and reversible encoding on Spark."""
