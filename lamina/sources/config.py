"""Configuration from nested JSON: unknown names are ignored, a section with an invalid value falls back to its defaults as a whole."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any, get_type_hints

from pyspark.sql import SparkSession


class Invalid(ValueError):
    """A value that its section refuses."""


def demand(test: bool, what: str) -> None:
    if not test:
        raise Invalid(what)


@dataclass(frozen=True)
class Scan:
    recursive: bool = True
    include_hidden: bool = False
    extensions: tuple[str, ...] = ("jpg", "jpeg")

    def __post_init__(self) -> None:
        demand(len(self.extensions) > 0 and all(e and e == e.lower().lstrip(".") for e in self.extensions), "extensions are lower case, without a dot")


@dataclass(frozen=True)
class Detector:
    pause_seconds: float = 20.0
    long_pause_seconds: float = 60.0
    composition_change: float = 0.025
    pause_change: float = 0.006

    def __post_init__(self) -> None:
        demand(0 < self.pause_seconds < float("inf"), "pause_seconds is positive and finite")
        demand(self.composition_change >= 0 and self.pause_change >= 0, "changes aren't negative")


@dataclass(frozen=True)
class Coverage:
    mode: str = "balanced"
    coverage_target: float | None = None
    min_coverage_gain: float = 0.002

    def __post_init__(self) -> None:
        demand(self.coverage_target is None or 0 <= self.coverage_target <= 1, "coverage_target lies in 0..1")


@dataclass(frozen=True)
class Output:
    engine: str = "ai"
    form: str = "jpg"
    folder: str = "output"

    def __post_init__(self) -> None:
        demand(self.form in ("jpg", "tif"), "form is jpg or tif")


@dataclass(frozen=True)
class Config:
    scan: Scan = field(default_factory=Scan)
    detector: Detector = field(default_factory=Detector)
    coverage: Coverage = field(default_factory=Coverage)
    output: Output = field(default_factory=Output)


def fitted(value: Any, kind: Any) -> Any:
    """``value`` as its field's type; a value of another type is invalid."""
    text = str(kind)
    if value is None:
        demand("None" in text, "null")
        return None
    if "bool" in text:
        demand(isinstance(value, bool), "a truth value")
        return value
    if "float" in text:
        demand(isinstance(value, int | float) and not isinstance(value, bool), "a number")
        return float(value)
    if "tuple" in text:
        demand(isinstance(value, list | tuple) and all(isinstance(v, str) for v in value), "a list of text")
        return tuple(value)
    demand(isinstance(value, str), "text")
    return value


def section(default: Any, given: Any) -> Any:
    """The section with the given values, or the defaults if one of them is refused."""
    if not isinstance(given, Mapping):
        return default
    kinds = get_type_hints(type(default))
    try:
        return replace(default, **{k: fitted(v, kinds[k]) for k, v in given.items() if k in kinds})
    except (Invalid, TypeError):
        return default


def parsed(text: str) -> Config:
    """Configuration of a JSON text; text that is no object is all defaults."""
    try:
        given = json.loads(text)
    except ValueError:
        return Config()
    given = given if isinstance(given, Mapping) else {}
    base = Config()
    return Config(**{f.name: section(getattr(base, f.name), given.get(f.name)) for f in fields(Config)})


def load(spark: SparkSession, path: str) -> Config:
    """The file's configuration; a file that isn't there is all defaults."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return Config()
    return parsed(spark.read.text(path, wholetext=True).first()[0])


def text(config: Config) -> str:
    return json.dumps(asdict(config), ensure_ascii=False, sort_keys=True, indent=1)
