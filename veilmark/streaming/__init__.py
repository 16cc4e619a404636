"""Micro-batch form of the text job."""
