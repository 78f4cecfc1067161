"""Training-data operators: ten corpus-scale components over documents, vectors and chats.

Nothing outside this subpackage imports it.
"""
