"""Training-data operators: ten self-contained modules over documents, vectors and chats.

Nothing outside this folder imports it; ``queries`` holds the registered
``opN_*`` queries and their SQL.
"""
