"""Alias maps for units, categories and metrics, applied as map literals."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings and the names they stand for.
UNITS = {"uv": "µV", "microvolt": "µV", "mv": "mV", "millivolt": "mV", "v": "V", "cmh2o": "cmH2O", "l": "L", "liter": "L", "ml": "mL", "l/s": "L/s", "s": "s", "sec": "s", "hz": "Hz", "au": "a.u."}
CATEGORIES = {"pressure": "airway_pressure", "paw": "airway_pressure", "airway pressure": "airway_pressure", "flow": "flow", "volume": "volume", "vol": "volume", "emg": "emg", "impedance": "impedance"}
METRICS = {"rr": "respiratory_rate", "respiratory rate": "respiratory_rate", "hr": "heart_rate", "tiv": "tidal_impedance_variation", "eeli": "end_expiratory_lung_impedance", "peep": "peep"}


class Vocabulary:
    """A case-insensitive alias map; unknown spellings stay as they are, trimmed."""

    def __init__(self, aliases: Mapping[str, str]):
        self._first = dict(aliases)
        self.aliases = dict(aliases)

    def register(self, alias: str, name: str) -> None:
        self.aliases[alias.strip().lower()] = name

    def reset(self) -> None:
        self.aliases = dict(self._first)

    def normalize(self, text: str) -> str:
        return self.aliases.get(text.strip().lower(), text.strip())

    def column(self, c: Column) -> Column:
        """``normalize`` as an expression: a literal map, no join and no Python."""
        literal = F.create_map(*[F.lit(x) for kv in sorted(self.aliases.items()) for x in kv])
        return F.coalesce(F.try_element_at(literal, F.lower(F.trim(c))), F.trim(c))

    def dump(self) -> str:
        return json.dumps(self.aliases, ensure_ascii=False, sort_keys=True)

    @classmethod
    def load(cls, text: str) -> "Vocabulary":
        return cls(json.loads(text))


units, categories, metrics = Vocabulary(UNITS), Vocabulary(CATEGORIES), Vocabulary(METRICS)


def channel_label(c: Column) -> Column:
    """A channel's label without a vendor tag in brackets at its end (``(pod)`` stays), white space collapsed, lower case."""
    collapsed = F.regexp_replace(F.trim(c), r"\s+", " ")
    tag = F.lower(collapsed).rlike(r"\(pod\)$")
    return F.lower(F.when(tag, collapsed).otherwise(F.regexp_replace(collapsed, r"\s*\([^()]*\)$", "")))


def stable_id(*parts: Column) -> Column:
    """A deterministic id of its parts: each is written as its length, a colon and itself, a null as a hyphen, so that no two lists of parts look alike."""
    written = [F.coalesce(F.concat(F.char_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*written), 256)


def round_half_even(seconds: Column, fs: float) -> Column:
    """Seconds to a sample index, halves to even."""
    return F.bround(seconds * F.lit(float(fs))).cast("long")


def truncate(seconds: Column, fs: float) -> Column:
    """Seconds to a sample index, cut towards zero."""
    return (seconds * F.lit(float(fs))).cast("long")
