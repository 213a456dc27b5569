"""The grid model: boxes, voxels, blocks, boundaries and the 26 features of a block.

Everything here is small and lives on the driver; tables of voxels are made from it by
``GridSpec.voxels``.  Phase convention: 1 is pore, 0 is solid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from enum import Enum
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


class Boundary(str, Enum):
    END = "end"
    WALL = "wall"
    PERIODIC = "periodic"
    INTERNAL = "internal"


#: Edges and corners take the first of these that one of their faces has.
PRECEDENCE = (Boundary.END, Boundary.WALL, Boundary.PERIODIC, Boundary.INTERNAL)


def boundary_order(kinds) -> Boundary:
    """END before WALL before PERIODIC before INTERNAL."""
    kinds = set(kinds)
    return next(k for k in PRECEDENCE if k in kinds)


Pair = tuple[float, float]


@dataclass(frozen=True)
class GridSpec:
    """A box cut into voxels, with a boundary type and inlet and outlet flags for each face.

    ``blocks`` cuts the grid into that many blocks an axis; the remainder goes to the last block.
    ``reservoir`` voxels are added beyond each inlet face.
    """

    voxels_shape: tuple[int, int, int]
    box: tuple[Pair, Pair, Pair] = ((0.0, 1.0), (0.0, 1.0), (0.0, 1.0))
    boundary: tuple[tuple[Boundary, Boundary], ...] = ((Boundary.END,) * 2,) * 3
    inlet: tuple[tuple[bool, bool], ...] = ((False, False),) * 3
    outlet: tuple[tuple[bool, bool], ...] = ((False, False),) * 3
    blocks: tuple[int, int, int] = (1, 1, 1)
    reservoir: int = 0

    def __post_init__(self):
        object.__setattr__(self, "boundary", tuple(tuple(Boundary(b) for b in pair) for pair in self.boundary))
        for lo, hi in self.box:
            if not hi > lo:
                raise ValueError("a box needs its upper bounds above its lower ones")
        if any(n < 2 for n in self.voxels_shape):
            raise ValueError("an axis needs two voxels at least")
        for a, b in self.boundary:
            if (a == Boundary.PERIODIC) != (b == Boundary.PERIODIC):
                raise ValueError("opposite faces are periodic together")
        if any(b < 1 or b > n for b, n in zip(self.blocks, self.voxels_shape, strict=True)):
            raise ValueError("an axis has between one and as many blocks as voxels")

    # -- the box
    @property
    def lengths(self) -> tuple[float, ...]:
        return tuple(hi - lo for lo, hi in self.box)

    @property
    def volume(self) -> float:
        return math.prod(self.lengths)

    @property
    def origin(self) -> tuple[float, ...]:
        return tuple(lo for lo, _ in self.box)

    @property
    def centroid(self) -> tuple[float, ...]:
        return tuple((lo + hi) / 2 for lo, hi in self.box)

    @property
    def radius(self) -> float:
        """Half the diagonal."""
        return math.sqrt(sum(x * x for x in self.lengths)) / 2

    @property
    def resolution(self) -> tuple[float, ...]:
        return tuple(length / n for length, n in zip(self.lengths, self.voxels_shape, strict=True))

    @property
    def periodic(self) -> tuple[bool, bool, bool]:
        return tuple(a == Boundary.PERIODIC for a, _ in self.boundary)

    @property
    def any_periodic(self) -> bool:
        return any(self.periodic)

    @property
    def size(self) -> int:
        return math.prod(self.voxels_shape)

    def has_boundary(self, kind: Boundary) -> bool:
        return any(kind in pair for pair in self.boundary)

    def coordinates(self, axis: int) -> list[float]:
        """Centroids of the voxels along an axis."""
        h, lo = self.resolution[axis], self.box[axis][0]
        return [lo + (i + 0.5) * h for i in range(self.voxels_shape[axis])]

    def with_blocks(self, blocks: tuple[int, int, int]) -> GridSpec:
        return replace(self, blocks=blocks)

    # -- faces
    def faces(self, flags: tuple[tuple[bool, bool], ...]) -> list[tuple[int, int]]:
        """(axis, 0 or 1) of the flagged faces; a flag counts only on an END face."""
        return [(a, s) for a in range(3) for s in (0, 1) if flags[a][s] and self.boundary[a][s] == Boundary.END]

    def on_face(self, axis: int, side: int) -> Column:
        """The voxels of a face, those of the reservoir's outermost slice where there is one."""
        low, high = self.extent(axis)
        return F.col(AXES[axis]) == F.lit(high - 1 if side else low)

    def on_faces(self, flags: tuple[tuple[bool, bool], ...]) -> Column:
        out = F.lit(False)
        for a, s in self.faces(flags):
            out = out | self.on_face(a, s)
        return out

    def extent(self, axis: int) -> tuple[int, int]:
        """First voxel and the one after the last, reservoirs included."""
        before, after = self.reservoir_pad[axis]
        return -before, self.voxels_shape[axis] + after

    @property
    def reservoir_pad(self) -> tuple[tuple[int, int], ...]:
        inlets = set(self.faces(self.inlet)) if self.reservoir else set()
        return tuple((self.reservoir * ((a, 0) in inlets), self.reservoir * ((a, 1) in inlets)) for a in range(3))

    def in_reservoir(self) -> Column:
        out = F.lit(False)
        for a, n in enumerate(self.voxels_shape):
            out = out | (F.col(AXES[a]) < 0) | (F.col(AXES[a]) >= n)
        return out

    def wall_slices(self) -> Column:
        """The outermost slices of WALL faces."""
        out = F.lit(False)
        for a in range(3):
            for s in (0, 1):
                if self.boundary[a][s] == Boundary.WALL:
                    out = out | self.on_face(a, s)
        return out

    # -- tables
    def voxels(self, spark: SparkSession) -> DataFrame:
        """vid, x, y, z of every voxel, reservoirs included; vid counts in C order over the extents."""
        (x0, x1), (y0, y1), (z0, z1) = (self.extent(a) for a in range(3))
        ny, nz = y1 - y0, z1 - z0
        i = F.col("id")
        return spark.range((x1 - x0) * ny * nz).select(
            i.alias("vid"),
            (F.floor(i / (ny * nz)) + x0).cast("int").alias("x"),
            (F.floor(i / nz) % ny + y0).cast("int").alias("y"),
            (i % nz + z0).cast("int").alias("z"),
        )

    def vid(self, x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> Column:
        (x0, _), (y0, y1), (z0, z1) = (self.extent(a) for a in range(3))
        x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
        return ((x - x0).cast("long") * (y1 - y0) + (y - y0)) * (z1 - z0) + (z - z0)

    def centre(self, axis: int, index: Column | None = None) -> Column:
        """The coordinate of a voxel's centroid."""
        i = F.col(AXES[axis]) if index is None else index
        return F.lit(float(self.box[axis][0])) + (i + 0.5) * F.lit(self.resolution[axis])

    def index_of(self, axis: int, coordinate: Column) -> Column:
        """The voxel that holds a coordinate; an error below the box and from its upper bound on."""
        lo, hi = self.box[axis]
        inside = (coordinate >= lo) & (coordinate < hi)
        at = F.floor((coordinate - lo) / self.resolution[axis]).cast("int")
        return F.when(inside, at).otherwise(F.raise_error(F.lit(f"coordinate outside [{lo}, {hi})")).cast("int"))

    # -- blocks
    def block_start(self, axis: int, i: int) -> int:
        return (self.voxels_shape[axis] // self.blocks[axis]) * i

    def block_voxels(self, axis: int, i: int) -> int:
        n, b = self.voxels_shape[axis], self.blocks[axis]
        return n // b + (n % b if i == b - 1 else 0)

    def block_of(self, axis: int, index: Column | None = None) -> Column:
        i = F.col(AXES[axis]) if index is None else index
        n, b = self.voxels_shape[axis], self.blocks[axis]
        return F.greatest(F.lit(0), F.least(F.floor(i / (n // b)), F.lit(b - 1))).cast("int")

    def block_index(self, rank: int) -> tuple[int, int, int]:
        _, by, bz = self.blocks
        return rank // (by * bz), rank // bz % by, rank % bz

    def block(self, rank: int, pad: tuple[int, int, int] = (0, 0, 0)) -> Block:
        return Block(self, rank, pad)

    @property
    def n_blocks(self) -> int:
        return math.prod(self.blocks)

    def block_map(self) -> dict[tuple[int, int, int], int]:
        """Rank by block index, one layer around included: -1 beyond END, -2 beyond WALL, wrapped where periodic."""
        out = {}
        for index in product(*(range(-1, b + 1) for b in self.blocks)):
            beyond = [self.boundary[a][int(i >= self.blocks[a])] for a, i in enumerate(index) if not 0 <= i < self.blocks[a]]
            if Boundary.END in beyond:
                out[index] = -1
            elif Boundary.WALL in beyond:
                out[index] = -2
            else:
                i, j, k = (v % b for v, b in zip(index, self.blocks, strict=True))
                out[index] = (i * self.blocks[1] + j) * self.blocks[2] + k
        return out

    def neighbour_ranks(self, rank: int) -> dict[tuple[int, int, int], int]:
        at, ranks = self.block_index(rank), self.block_map()
        return {d: ranks[tuple(a + s for a, s in zip(at, d, strict=True))] for d in FEATURES}


def _features() -> tuple[tuple[int, int, int], ...]:
    every = [d for d in product((-1, 0, 1), repeat=3) if any(d)]
    return tuple(sorted(every, key=lambda d: (sum(map(abs, d)), d)))


#: Directions of the 6 faces, 12 edges and 8 corners, in this order.
FEATURES = _features()
FACES, EDGES, CORNERS = FEATURES[:6], FEATURES[6:18], FEATURES[18:]


def feature_id(direction: tuple[int, int, int]) -> int:
    """0 to 26: - counts 0, + 1 and 0 counts 2, with weights 9, 3 and 1."""
    return sum(w * (0 if d < 0 else 1 if d > 0 else 2) for w, d in zip((9, 3, 1), direction, strict=True))


def opposite(direction: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(-d for d in direction)


def faces_of(direction: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """The faces that meet in an edge or corner."""
    return [tuple(d if b == a else 0 for b in range(3)) for a, d in enumerate(direction) if d]


def edges_of(corner: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    return [tuple(0 if b == a else d for b, d in enumerate(corner)) for a in (2, 1, 0)]


def argument_order(face: tuple[int, int, int]) -> tuple[int, int, int]:
    """The face's own axis, then the others in order."""
    axis = next(a for a, d in enumerate(face) if d)
    return (axis, *(a for a in range(3) if a != axis))


def is_forward(face: tuple[int, int, int]) -> bool:
    return not any(d > 0 for d in face)


def face_index(face: tuple[int, int, int]) -> int:
    """0 to 5: lower and upper face of x, y and z."""
    axis = next(a for a, d in enumerate(face) if d)
    return 2 * axis + (face[axis] > 0)


def offsets(spark: SparkSession) -> DataFrame:
    """The 26 directions as a table: feature, dx, dy, dz and kind."""
    kinds = {1: "face", 2: "edge", 3: "corner"}
    return spark.createDataFrame([(feature_id(d), *d, kinds[sum(map(abs, d))]) for d in FEATURES], "feature int, dx int, dy int, dz int, kind string")


@dataclass(frozen=True)
class Block:
    """One block of a decomposed grid with a halo of ``pad`` voxels (0 beyond END, 1 beyond WALL)."""

    grid: GridSpec
    rank: int
    pad: tuple[int, int, int] = (0, 0, 0)
    index: tuple[int, int, int] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "index", self.grid.block_index(self.rank))

    def _at_edge(self, axis: int, side: int) -> bool:
        return self.index[axis] == (self.grid.blocks[axis] - 1 if side else 0)

    @property
    def own_shape(self) -> tuple[int, ...]:
        return tuple(self.grid.block_voxels(a, i) for a, i in enumerate(self.index))

    @property
    def boundary(self) -> tuple[tuple[Boundary, Boundary], ...]:
        """The domain's types on its own faces, INTERNAL elsewhere."""
        return tuple(tuple(self.grid.boundary[a][s] if self._at_edge(a, s) else Boundary.INTERNAL for s in (0, 1)) for a in range(3))

    @property
    def global_boundary(self) -> tuple[tuple[bool, bool], ...]:
        return tuple(tuple(self._at_edge(a, s) for s in (0, 1)) for a in range(3))

    def flags(self, of: tuple[tuple[bool, bool], ...]) -> tuple[tuple[bool, bool], ...]:
        faces = set(self.grid.faces(of))
        return tuple(tuple((a, s) in faces and self._at_edge(a, s) for s in (0, 1)) for a in range(3))

    @property
    def inlet(self):
        return self.flags(self.grid.inlet)

    @property
    def outlet(self):
        return self.flags(self.grid.outlet)

    @property
    def padding(self) -> tuple[tuple[int, int], ...]:
        def one(axis: int, side: int) -> int:
            kind = self.boundary[axis][side]
            return 0 if kind == Boundary.END else 1 if kind == Boundary.WALL else self.pad[axis]

        return tuple((one(a, 0), one(a, 1)) for a in range(3))

    def extended(self, pad: tuple[int, int, int]) -> tuple[tuple[int, int], ...]:
        """More padding on top of the block's own: none beyond END, and none beyond a WALL that has its layer."""
        def one(axis: int, side: int) -> int:
            kind = self.boundary[axis][side]
            return 0 if kind == Boundary.END or kind == Boundary.WALL and self.padding[axis][side] == 1 else pad[axis]

        return tuple((one(a, 0), one(a, 1)) for a in range(3))

    @property
    def reservoir_padding(self) -> tuple[tuple[int, int], ...]:
        n = self.grid.reservoir
        return tuple((n * self.inlet[a][0], n * self.inlet[a][1]) for a in range(3))

    @property
    def start(self) -> tuple[int, ...]:
        """The first voxel of the padded block; may be negative."""
        return tuple(self.grid.block_start(a, i) - self.padding[a][0] - self.reservoir_padding[a][0] for a, i in enumerate(self.index))

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(n + sum(p) + sum(r) for n, p, r in zip(self.own_shape, self.padding, self.reservoir_padding, strict=True))

    @property
    def own(self) -> tuple[tuple[int, int], ...]:
        """The own voxels within the padded block, [first, last) an axis."""
        return tuple((p[0] + r[0], p[0] + r[0] + n) for n, p, r in zip(self.own_shape, self.padding, self.reservoir_padding, strict=True))

    @property
    def box(self) -> tuple[Pair, ...]:
        return tuple((lo + s * h, lo + (s + n) * h) for (lo, _), h, s, n in zip(self.grid.box, self.grid.resolution, self.start, self.shape, strict=True))

    @property
    def own_box(self) -> tuple[Pair, ...]:
        return tuple((lo + self.grid.block_start(a, i) * h, lo + (self.grid.block_start(a, i) + n) * h) for a, (i, (lo, _), h, n) in enumerate(zip(self.index, self.grid.box, self.grid.resolution, self.own_shape, strict=True)))

    @property
    def lengths(self) -> tuple[float, ...]:
        return tuple(hi - lo for lo, hi in self.box)

    @property
    def centroid(self) -> tuple[float, ...]:
        return tuple((lo + hi) / 2 for lo, hi in self.box)

    @property
    def radius(self) -> float:
        return math.sqrt(sum(x * x for x in self.lengths)) / 2

    @property
    def periodic(self) -> bool:
        return any(k == Boundary.PERIODIC for pair in self.boundary for k in pair)

    def feature(self, direction: tuple[int, int, int]) -> dict:
        """Type, windows and periodic shift of a face, edge or corner of the block.

        ``own``: the voxels that a neighbour needs; ``halo``: those that it fills, None without a pad.
        """
        kinds = [self.boundary[a][d > 0] for a, d in enumerate(direction) if d]
        kind = Boundary.INTERNAL if all(k == Boundary.INTERNAL for k in kinds) else boundary_order(k for k in kinds if k != Boundary.INTERNAL)
        own, halo = [], []
        for a, d in enumerate(direction):
            n, (before, after) = self.shape[a], self.padding[a]
            p = before if d < 0 else after
            if d == 0:
                own.append((before, n - after))
                halo.append((before, n - after))
                continue
            depth = 1 if kind == Boundary.WALL else max(p, 1)
            skip = 0 if not p else 1 if kind == Boundary.WALL else p
            own.append((skip, skip + depth) if d < 0 else (n - skip - depth, n - skip))
            edge = 1 if kind == Boundary.WALL else p
            halo.append((0, edge) if d < 0 else (n - edge, n))
        shift = tuple((-d if self.grid.periodic[a] and self._at_edge(a, d > 0) else 0) if d else 0 for a, d in enumerate(direction))
        return {
            "id": feature_id(direction), "opposite": opposite(direction), "boundary": kind, "periodic": kind == Boundary.PERIODIC,
            "global": all(self._at_edge(a, d > 0) for a, d in enumerate(direction) if d),
            "own": tuple(own), "halo": tuple(halo) if any(map(any, self.padding)) else None, "shift": shift,
            "rank": self.grid.neighbour_ranks(self.rank)[direction],
        }

    def features(self) -> dict[tuple[int, int, int], dict]:
        return {d: self.feature(d) for d in FEATURES}

    def periodic_features(self) -> dict[tuple[int, int, int], tuple[int, ...]]:
        return {d: f["shift"] for d, f in self.features().items() if f["periodic"]}

    def member(self, direction: tuple[int, int, int], name: str):
        """One entry of a feature: KeyError for an unknown feature, AttributeError for an unknown entry."""
        found = self.features()[tuple(direction)]
        if name not in found:
            raise AttributeError(name)
        return found[name]

    # -- cells for pruning
    def cells(self, shape: tuple[int, int, int]) -> list[dict]:
        """The block cut into cells: voxel ranges, box, centre and diagonal of each."""
        out = []
        for at in product(*map(range, shape)):
            ranges = []
            for a, i in enumerate(at):
                n, c = self.shape[a], shape[a]
                ranges.append((i * (n // c), n if i == c - 1 else (i + 1) * (n // c)))
            box = [(lo + s * h, lo + e * h) for (lo, _), h, (s, e) in zip(self.box, self.grid.resolution, ranges, strict=True)]
            out.append({"index": at, "voxels": tuple(ranges), "box": tuple(box), "centre": tuple((a + b) / 2 for a, b in box), "diameter": math.sqrt(sum((b - a) ** 2 for a, b in box))})
        return out


def voxel_id(index: tuple[int, ...], shape: tuple[int, ...]) -> int:
    """C-order id of a voxel, indices wrapped into the grid."""
    out = 0
    for i, n in zip(index, shape, strict=True):
        out = out * n + i % n
    return out


def decompose_window(start: tuple[int, ...], shape: tuple[int, ...], grid: GridSpec) -> Column:
    """Membership of voxels in a window that may wrap around the grid."""
    out = F.lit(True)
    for a in range(3):
        out = out & (F.pmod(F.col(AXES[a]) - start[a], F.lit(grid.voxels_shape[a])) < shape[a])
    return out
