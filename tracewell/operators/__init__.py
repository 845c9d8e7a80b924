"""Dataflow operators over flows of packets, messages and samples."""
