"""Operators over particles, voxels and curves."""
