"""Readers, decoders and encoders."""
