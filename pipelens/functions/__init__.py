"""Column functions: comparison semantics of data frames, seeded hashing, text."""
