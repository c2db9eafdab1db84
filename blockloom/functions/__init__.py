"""Scalar functions of contract data: hashes, codec, hex, unit shifts, calls."""
