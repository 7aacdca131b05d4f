"""Shared column expressions, tiled order-dependent helpers and in-task kernels."""
