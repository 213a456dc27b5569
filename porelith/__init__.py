"""porelith: analytics of porous structures on voxel grids, declared as Spark DataFrames."""

__version__ = "0.1.0"
