"""Aligning cubes: choose a target grid, coarsen where it pays, resample each variable by its method, merge."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from terracell.cube import Cube
from terracell.grid import GridSpec, snapped
from terracell.operators.coarsen import coarsen
from terracell.operators.merge import merge, prefixed
from terracell.operators.reproject import METHODS, reproject

Methods = str | Mapping[str, object]


def parsed(method: object) -> str:
    """A resampling method by its name, whatever the case."""
    if not isinstance(method, str):
        raise TypeError(f"a resampling method is a name, not {type(method).__name__}")
    if method.lower() not in METHODS:
        raise ValueError(f"unknown resampling {method!r}; there are {', '.join(METHODS)}")
    return method.lower()


def methods_of(name: str, variables: list[str], spec: Methods | None) -> dict[str, str]:
    """The method of each variable of a dataset.

    spec: a method for everything, or one for each dataset by name (nearest for those it lacks), itself a method or
    {"default": method, "vars": {variable: method}}; variables that the dataset lacks are ignored.
    """
    if spec is None or isinstance(spec, str):
        own: object = spec or "nearest"
    elif isinstance(spec, Mapping):
        own = spec.get(name, "nearest")
    else:
        raise TypeError("resampling must be a name or a mapping")
    if isinstance(own, Mapping):
        default, table = parsed(own.get("default", "nearest")), own.get("vars", {})
        return {v: parsed(table.get(v, default)) for v in variables}
    return dict.fromkeys(variables, parsed(own))


@dataclass(frozen=True)
class Aligner:
    """How cubes are brought together.

    target: the name of the cube whose grid is taken, or a grid. resolution: other cells over the target's
    extent. snap: how the resolution moves to a multiple of the target's own. coarsen_first: cubes whose cells
    go a whole number of times, at least this often, into the target's are coarsened by that factor before they
    are resampled (0: never); it saves most of the rows that a resampling would shuffle. prefix: variables get
    their cube's name in front, so that equal names can't conflict.
    """

    target: str | GridSpec
    resolution: float | None = None
    resampling: Methods | None = None
    snap: str = "off"
    coarsen_first: int = 0
    coarsen_methods: str | Mapping[str, str] = "auto"
    prefix: bool = False

    def grid(self, cubes: Mapping[str, Cube]) -> GridSpec:
        if isinstance(self.target, GridSpec):
            grid = self.target
        elif self.target in cubes:
            grid = cubes[self.target].grid
        else:
            raise ValueError(f"no cube {self.target!r} to align to; there are {sorted(cubes)}")
        if self.resolution is None:
            return grid
        return grid.at_resolution(snapped(grid.resolution[0], self.resolution, self.snap), snapped(grid.resolution[1], self.resolution, self.snap))

    def align(self, cubes: Mapping[str, Cube]) -> Cube:
        """One cube with all variables on the target grid, named longitude and latitude; nothing runs yet."""
        if not cubes:
            raise ValueError("no cubes to align")
        target, out = self.grid(cubes), []
        for name, cube in cubes.items():
            if not isinstance(cube, Cube):
                raise TypeError(f"{name} is no cube")
            if not cube.variables:
                raise ValueError(f"{name} has no variables")
            if not cube.grid.crs:
                raise ValueError(f"{name} has no CRS")
            methods = methods_of(name, cube.variables, self.resampling)
            factor = self.factor(cube.grid, target)
            if factor > 1:
                cube = coarsen(cube, factor, self.coarsen_methods)
            if replace(cube.grid, x_name=target.x_name, y_name=target.y_name) != target:
                cube = reproject(cube, target, methods)
            cube = cube.having(cube.df, grid=target)
            out.append(prefixed(cube, name) if self.prefix else cube)
        merged = merge(out)
        return merged.having(merged.df, grid=replace(target, x_name="longitude", y_name="latitude"))

    def factor(self, source: GridSpec, target: GridSpec) -> int:
        if not self.coarsen_first or source.crs != target.crs:
            return 1
        ratio = target.resolution[0] / source.resolution[0]
        whole = round(ratio)
        same = abs(ratio - whole) < 1e-9 and abs(target.resolution[1] / source.resolution[1] - whole) < 1e-9
        return whole if same and whole >= max(2, self.coarsen_first) else 1
