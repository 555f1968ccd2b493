"""Kernels on one frame (numpy arrays, rows by columns), for what is ordered within a frame; frames run in parallel."""
