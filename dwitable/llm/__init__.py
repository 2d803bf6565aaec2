"""Operators of a training-data pipeline: secrets, copies, archives, neighbours, classifiers, packing, extraction, chats, words."""
