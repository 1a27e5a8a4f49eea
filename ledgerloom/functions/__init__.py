"""Scalar functions: identities, digests, codecs, checked arithmetic."""
