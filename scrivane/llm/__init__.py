"""Training-data operators: personal data, overlap, near-duplicates, copies, sampling, encoding, mixing, residue.

Nothing outside this subpackage imports it; ``registry`` names its queries and their SQL.
"""
