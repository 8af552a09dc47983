"""Options of a tiling run: names, types, defaults and checks."""

from __future__ import annotations

import argparse
import warnings
from dataclasses import dataclass, field, fields

from ..sinks.codecs import ENDINGS

OUTPUTS = (*sorted(ENDINGS), "simulate", "parquet")
STAGES = ("split", "gen-problem-list", "handle-problem-list", "dist")
POLICIES = ("remove", "fake", "keep")
#: Tiles grow by so many units where objects are not kept complete.
PLAIN_OVERLAP = 2000
MAX_MAP_ID = 99_999_999


@dataclass
class Options:
    files: list[str] = field(default_factory=list)
    mapid: int = 63240001
    description: str | None = None
    max_areas: int = 2048
    overlap: int | None = None
    max_nodes: int = 1_600_000
    num_tiles: int | None = None
    resolution: int = 13
    mixed: bool = False
    cache: str | None = None
    output_dir: str = "."
    split_file: str | None = None
    geonames_file: str | None = None
    write_kml: str | None = None
    no_trim: bool = False
    max_threads: str = "auto"
    output: str = "pbf"
    problem_file: str | None = None
    keep_complete: bool = True
    problem_report: str | None = None
    polygon_file: str | None = None
    polygon_desc_file: str | None = None
    stop_after: str = "dist"
    precomp_sea: str | None = None
    density_file: str | None = None
    boundary_tags: str = "use-exclude-list"
    wanted_admin_level: int = 5
    search_limit: int = 200_000
    handle_element_version: str = "remove"
    ignore_osm_bounds: bool = False
    status_freq: int = 120

    def check(self) -> Options:
        """Raises ValueError on a wrong value; options without effect here are warned about."""
        rules = [
            (0 <= self.mapid <= MAX_MAP_ID, "mapid must be 0 to 99999999"),
            (self.max_nodes >= 10_000, "max-nodes must be 10000 or more"),
            (self.num_tiles is None or self.num_tiles >= 2, "num-tiles must be 2 or more"),
            (1 <= self.resolution <= 24, "resolution must be 1 to 24"),
            (1 <= self.max_areas <= 9999, "max-areas must be 1 to 9999"),
            (self.search_limit >= 1000, "search-limit must be 1000 or more"),
            (0 <= self.wanted_admin_level <= 12, "wanted-admin-level must be 0 to 12"),
            (self.output in OUTPUTS, f"output must be one of {', '.join(OUTPUTS)}"),
            (self.stop_after in STAGES, f"stop-after must be one of {', '.join(STAGES)}"),
            (self.handle_element_version in POLICIES, f"handle-element-version must be one of {', '.join(POLICIES)}"),
            (not (self.polygon_file and self.polygon_desc_file), "polygon-file and polygon-desc-file exclude each other"),
            (not (self.mixed and (self.keep_complete or self.problem_file)), "mixed excludes keep-complete and problem-file"),
            (self.overlap is None or self.overlap >= 0, "overlap must not be negative"),
        ]
        for ok, text in rules:
            if not ok:
                raise ValueError(text)
        if self.cache:
            warnings.warn("cache has no effect", stacklevel=2)
        if self.problem_file and not self.keep_complete:
            warnings.warn("problem-file has no effect without keep-complete", stacklevel=2)
        return self

    @property
    def grown_by(self) -> int:
        return self.overlap if self.overlap is not None else 0 if self.keep_complete else PLAIN_OVERLAP

    @property
    def boundaries(self) -> tuple[str, ...] | None:
        return None if self.boundary_tags == "use-exclude-list" else tuple(t.strip() for t in self.boundary_tags.split(",") if t.strip())


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def _number(text: str) -> int:
    return int(text.replace("_", "").replace(",", ""))


def parse(args: list[str]) -> Options:
    """``--kebab-case=value`` options and input files; a repeated option warns, the last one counts."""
    parser = argparse.ArgumentParser(prog="tessera", description="Cuts map files into tiles.")
    parser.add_argument("files", nargs="*")
    kinds = {"int": _number, "int | None": _number, "bool": _flag}
    for f in fields(Options):
        if f.name != "files":
            parser.add_argument("--" + f.name.replace("_", "-"), dest=f.name, type=kinds.get(f.type, str), default=f.default,
                                metavar=f.name.upper())
    flags = {"--" + f.name.replace("_", "-") for f in fields(Options) if f.type == "bool"}
    args = [f"{a}=true" if a in flags else a for a in args]
    names = [a.split("=")[0] for a in args if a.startswith("--")]
    for name in {n for n in names if names.count(n) > 1}:
        warnings.warn(f"{name} is given more than once", stacklevel=2)
    return Options(**vars(parser.parse_args(args))).check()
