"""Training-data operators: thirteen stand-alone stages over documents, pages, conversations and vectors.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
