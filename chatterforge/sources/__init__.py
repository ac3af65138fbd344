"""Files of the chat-data world as DataFrames, and back."""
