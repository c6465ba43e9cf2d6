"""What a dataset's attributes say: its CRS, its axes, and which attributes are kept."""

from __future__ import annotations

from collections.abc import Mapping

# Fixed names, in the order in which they are looked for.
X_NAMES = ("longitude", "lon", "x")
Y_NAMES = ("latitude", "lat", "y")
CRS_VARIABLES = ("spatial_ref", "crs")
CRS_KEYS = ("crs_wkt", "spatial_ref")
#: Attributes that a store's encoding holds, which mustn't be attributes as well.
ENCODED = ("_FillValue", "missing_value", "scale_factor", "add_offset", "dtype")


def axis(columns: list[str], candidates: tuple[str, ...]) -> str:
    """The first candidate that is a column."""
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"none of {candidates} among {columns}")


def axes(columns: list[str]) -> tuple[str, str]:
    return axis(columns, X_NAMES), axis(columns, Y_NAMES)


def crs_of(variables: Mapping[str, Mapping[str, object]], attributes: Mapping[str, object], stated: str | None = None) -> str:
    """The CRS that is stated, or else that of a grid-mapping variable, or of the dataset; ValueError if there is none."""
    found = [stated, *[variables.get(v, {}).get(k) for v in CRS_VARIABLES for k in CRS_KEYS], attributes.get("crs"), attributes.get("spatial_ref")]
    for value in found:
        if value:
            return str(value)
    raise ValueError("the dataset has no CRS: give one, or a spatial_ref variable with crs_wkt")


def kept(attributes: Mapping[str, object]) -> dict[str, object]:
    """Attributes to write: none that is None, and none that the encoding holds."""
    return {k: v for k, v in attributes.items() if v is not None and k not in ENCODED}
