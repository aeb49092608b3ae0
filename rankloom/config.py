"""Settings of the extraction, screens and their tabs, with defaults for what a definition leaves out."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from functools import cache
from pathlib import Path
from typing import Any

# Words of the game's screens that are never player names.
UI_LABELS = (
    "ranking", "commander", "points", "power", "kills", "donation", "daily rank", "weekly rank", "strength ranking",
    "mon", "tues", "wed", "thur", "fri", "sat", "your alliance",
)
# Alliance names that are shown below player names.
ALLIANCE_SUFFIXES = ("Pantheon of Wrath",)
# Days in order, with the labels of their tabs; each label also occurs with a full stop.
DAYS = {"monday": "mon", "tuesday": "tues", "wednesday": "wed", "thursday": "thur", "friday": "fri", "saturday": "sat"}
# The categories of a leaderboard.
SEASON_PARTS = (("mutual_assistance", "siege", "rare_soil_war", "defeat"), ("daily", "weekly", "season"))
CATEGORIES = (*DAYS, "weekly", "power", "kills", "donation_daily", "donation_weekly", *(f"{a}_{b}" for a in SEASON_PARTS[0] for b in SEASON_PARTS[1]))

# Limits of a stitched image.
SEPARATOR_PX, MOST_PIXELS, MOST_BYTES, MOST_IMAGES = 10, 75_000_000, 20 * 1024 * 1024, 100


def day_labels() -> dict[str, str]:
    """Label in lower case -> day: the name, the short form, and the short form with a full stop."""
    return {label: day for day, short in DAYS.items() for label in (short, f"{short}.", day)}


# The defaults.
@dataclass(frozen=True)
class Hsv:
    """Bounds of a colour: hue between two values, saturation and brightness from one on."""

    h_min: float = 0.014
    h_max: float = 0.153
    s_min: float = 0.40
    v_min: float = 0.55


@dataclass(frozen=True)
class Color:
    name: str = ""
    hsv_override: Hsv | None = None


@dataclass(frozen=True)
class ActiveIndicator:
    """How the active tab of a row shows."""

    strategy: str = "color_fraction"
    color: Color | None = None
    min_fraction: float = 0.10
    min_gap: float = 0.04
    bbox_padding_fraction: float = 0.007

    @property
    def hsv(self) -> Hsv:
        return self.color.hsv_override if self.color and self.color.hsv_override else Hsv()


@dataclass(frozen=True)
class TabItem:
    category: str = ""
    signals: tuple[str, ...] = ()
    group: str | None = None


@dataclass(frozen=True)
class TabGroup:
    strategy: str = "color_fraction"
    min_fraction: float = 0.10


@dataclass(frozen=True)
class Tabs:
    items: tuple[TabItem, ...] = ()
    groups: Mapping[str, TabGroup] = field(default_factory=dict)
    active_indicator: ActiveIndicator = ActiveIndicator()


@dataclass(frozen=True)
class Region:
    """A part of the screen in fractions of its size."""

    x: float = 0.0
    y: float = 0.0
    width: float = 1.0
    height: float = 1.0


@dataclass(frozen=True)
class Hint:
    region: Region | None = None
    color: Color | None = None
    min_fraction: float = 0.10


@dataclass(frozen=True)
class Anchor:
    text: str = ""
    edge: str = "bottom"


@dataclass(frozen=True)
class Chrome:
    top: Anchor | None = None
    bottom: Anchor | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str = ""
    x_min: float = 0.0
    x_max: float = 1.0
    kind: str = "text"


# The defaults.
@dataclass(frozen=True)
class ScoreAnchored:
    up_band_fraction: float = 0.021
    down_band_fraction: float = 0.002


@dataclass(frozen=True)
class YProximity:
    tolerance_fraction: float = 0.02
    min_tolerance_px: int = 20


# The defaults.
@dataclass(frozen=True)
class RowClustering:
    """How words become rows: the band around a score, its least value, and the gap that is a space."""

    strategy: str = "score_anchored"
    score_anchored: ScoreAnchored = ScoreAnchored()
    y_proximity: YProximity = YProximity()
    min_score: int = 1000
    word_gap_fraction: float = 0.015
    min_word_gap_px: int = 8

    def bands(self, height: int) -> tuple[int, int]:
        """Pixels above and below a score in which the words of its row are."""
        a = self.score_anchored
        return max(1, int(a.up_band_fraction * height)), max(1, int(a.down_band_fraction * height))

    def gap(self, width: int) -> int:
        return max(self.min_word_gap_px, int(width * self.word_gap_fraction)) if width else 2 * self.min_word_gap_px


# The defaults.
@dataclass(frozen=True)
class WindowDetection:
    near_black_max_channel: int = 20
    border_coverage_threshold: float = 0.95
    sample_count: int = 64
    min_window_fraction: float = 0.20
    bbox_padding_fraction: float = 0.02


# The defaults.
@dataclass(frozen=True)
class RgbBounds:
    """Strict bounds on red and blue, inclusive ones on green."""

    r_min: int = 180
    g_min: int = 60
    g_max: int = 180
    b_max: int = 90


# The defaults.
@dataclass(frozen=True)
class Constants:
    window: WindowDetection = WindowDetection()
    orange: RgbBounds = RgbBounds()
    orange_hsv: Hsv = Hsv()
    white_min_channel: int = 215
    score_suffix: str = r"\d{1,3}(,\d{3})+"


@dataclass(frozen=True)
class Screen:
    """One kind of screen: how it is told from others, its tabs, and how its rows are read."""

    id: str = ""
    title: str = ""
    priority: int = 99
    page_signals: tuple[str, ...] = ()
    negative_signals: tuple[str, ...] = ()
    tabs: Tabs | None = None
    pre_ocr_hint: Hint | None = None
    chrome: Chrome | None = None
    columns: tuple[ColumnDef, ...] = ()
    row_clustering: RowClustering = RowClustering()


_PARTS: dict[str, Any] = {
    "hsv_override": Hsv, "color": Color, "active_indicator": ActiveIndicator, "tabs": Tabs, "region": Region, "pre_ocr_hint": Hint, "chrome": Chrome,
    "top": Anchor, "bottom": Anchor, "score_anchored": ScoreAnchored, "y_proximity": YProximity, "row_clustering": RowClustering,
    "window": WindowDetection, "orange": RgbBounds, "orange_hsv": Hsv,
}
_LISTS: dict[str, Any] = {"items": TabItem, "columns": ColumnDef}


def parse(kind: Any, given: Mapping[str, Any] | None) -> Any:
    """A record of dataclass ``kind`` from a mapping; what is left out or null has its default, what isn't known is left out."""
    values: dict[str, Any] = {}
    for f in fields(kind):
        v = (given or {}).get(f.name)
        if v is None:
            continue
        if f.name in _LISTS:
            v = tuple(parse(_LISTS[f.name], x) for x in v)
        elif f.name == "groups":
            v = {k: parse(TabGroup, x) for k, x in v.items()}
        elif f.name in _PARTS and isinstance(v, Mapping):
            v = parse(_PARTS[f.name], v)
        elif isinstance(v, list):
            v = tuple(v)
        values[f.name] = v
    return kind(**values)


def check_screen(given: Any, name: str = "screen") -> None:
    """Raise RuntimeError unless a definition has an id and its lists and mappings are such."""
    if not isinstance(given, Mapping) or not isinstance(given.get("id"), str) or not given["id"]:
        raise RuntimeError(f"{name}: a screen needs an id")
    for key, kind in (("page_signals", list), ("negative_signals", list), ("tabs", Mapping), ("row_clustering", Mapping), ("columns", list)):
        if given.get(key) is not None and not isinstance(given[key], (kind, tuple) if kind is list else kind):
            raise RuntimeError(f"{name}: {key} must be a {kind.__name__}")
    if not isinstance(given.get("priority", 99), int):
        raise RuntimeError(f"{name}: priority must be a number")
    for t in (given.get("tabs") or {}).get("items") or []:
        if not isinstance(t, Mapping) or not isinstance(t.get("category"), str):
            raise RuntimeError(f"{name}: a tab needs a category")


def load_screens(folder: str | Path) -> tuple[Screen, ...]:
    """All ``*.json`` definitions of a folder (and ``*.yaml`` where a YAML reader is installed), by priority."""
    given = []
    for p in sorted(Path(folder).iterdir()):
        if p.suffix == ".json":
            given.append((p.name, json.loads(p.read_text())))
        elif p.suffix in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError(f"{p.name}: no YAML reader is installed") from e
            given.append((p.name, yaml.safe_load(p.read_text())))
    for name, g in given:
        check_screen(g, name)
    return tuple(sorted((parse(Screen, g) for _, g in given), key=lambda s: s.priority))


@cache
def default_screens() -> tuple[Screen, ...]:
    """The screens that are used where no folder of definitions is given."""
    day_tabs = [{"category": d, "signals": [s.capitalize()]} for d, s in DAYS.items()]
    season = [{"category": c, "signals": [c.replace("_", " ").title()], "group": "category"} for c in SEASON_PARTS[0]]
    season += [{"category": "daily", "signals": ["Daily"], "group": "period"}, {"category": "weekly", "signals": ["Weekly"], "group": "period"}]
    season += [{"category": "season", "signals": ["Season Total Ranking"], "group": "period"}]
    given = [
        {"id": "strength_donation", "title": "Strength Ranking", "priority": 10, "page_signals": ["Strength Daily Weekly"],
         "tabs": {"items": [{"category": f"donation_{p}", "signals": ["Donation", p.capitalize()]} for p in ("daily", "weekly")]}},
        {"id": "strength_metrics", "title": "Strength Ranking", "priority": 20, "page_signals": ["Strength Ranking"],
         "tabs": {"items": [{"category": c, "signals": [c.capitalize()]} for c in ("power", "kills")]}},
        {"id": "alliance_contribution", "title": "Alliance Contribution", "priority": 60, "page_signals": ["Alliance Contribution"],
         "tabs": {"items": season, "groups": {"category": {}, "period": {"strategy": "brightest", "min_fraction": 0.02}}}},
        {"id": "weekly_ranking", "title": "Weekly Rank", "priority": 40, "page_signals": ["Weekly Rank"], "negative_signals": [f"{s.capitalize()}." for s in DAYS.values()],
         "tabs": {"items": [{"category": "weekly", "signals": ["Weekly Rank"]}]}},
        {"id": "daily_ranking", "title": "Daily Rank", "priority": 50, "page_signals": ["Daily Rank"], "tabs": {"items": day_tabs}},
    ]
    for g in given:
        check_screen(g)
    return tuple(sorted((parse(Screen, g) for g in given), key=lambda s: s.priority))


def screen(id_: str, screens: tuple[Screen, ...] | None = None) -> Screen | None:
    return next((s for s in (screens or default_screens()) if s.id == id_), None)


def screen_of(category: str | None, screens: tuple[Screen, ...] | None = None) -> Screen | None:
    """The first screen by priority that has a tab of this category."""
    return next((s for s in (screens or default_screens()) if s.tabs and any(t.category == category for t in s.tabs.items)), None)


def rows_of(category: str | None, screens: tuple[Screen, ...] | None = None) -> RowClustering:
    s = screen_of(category, screens)
    return s.row_clustering if s else RowClustering()
