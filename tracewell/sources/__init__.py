"""Readers of binary captures, elementary streams and PCM files."""
