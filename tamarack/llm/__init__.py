"""Operations of a training-data pipeline: filtering, deduplication, mixing and packing of documents.

Nothing outside this folder imports it; it imports nothing from the rest of the library.
"""
