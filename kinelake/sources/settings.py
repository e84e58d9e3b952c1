"""Settings of a run: defaults, files, and merging."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from kinelake.exceptions import UnknownName

DEFAULTS: dict = {
    "normalize": {"steps": [{"type": "butterworth", "cutoff": 4.0, "order": 2}], "gap_max": 10},
    "angles": {"method": "sagittal_vertical_axis", "factor": 0.8, "calibrate": True},
    "events": {"method": "zeni", "least": 0.4, "cutoff": 6.0},
    "cycles": {"shortest": 0.4, "longest": 2.5, "points": 101},
    "corrections": {"ankle_projection": False, "drift": False, "one_direction": True},
    "scores": {"stratum": "adult"},
}


def merged(base: dict, over: dict) -> dict:
    """base with over's values; dicts within are merged too, and neither argument changes."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


#: Settings by name. ``recipe`` is the one that was validated against optical recordings: no calibration, cycles of 0.8 to
#: 1.6 s, contacts 0.6 s apart; ``defaults`` are those of the steps by themselves.
PRESETS: dict[str, dict] = {
    "defaults": DEFAULTS,
    "recipe": merged(DEFAULTS, {"angles": {"calibrate": False}, "events": {"least": 0.6}, "cycles": {"shortest": 0.8, "longest": 1.6}}),
}


def preset(name: str) -> dict:
    if name not in PRESETS:
        raise UnknownName(name)
    return PRESETS[name]


def load(path: str | Path) -> dict:
    """The defaults with the values of a JSON file, or of a YAML file where that library is there."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yml", ".yaml")):
        import yaml

        return merged(DEFAULTS, yaml.safe_load(text) or {})
    return merged(DEFAULTS, json.loads(text))


def save(settings: dict, path: str | Path) -> None:
    if str(path).endswith((".yml", ".yaml")):
        import yaml

        text = yaml.safe_dump(settings, sort_keys=True)
    else:
        text = json.dumps(settings, indent=2, sort_keys=True)
    Path(path).write_text(text, encoding="utf-8")
