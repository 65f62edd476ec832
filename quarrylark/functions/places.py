"""Location parsing over a gazetteer (LOC-01 to LOC-04)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylark.functions.text import column_udf


@dataclass(frozen=True)
class Gazetteer:
    """Folded names; all of it is configuration."""

    countries: dict[str, str] = field(default_factory=dict)  # name or code -> country
    cities: dict[str, str] = field(default_factory=dict)  # city -> country
    regions: dict[str, tuple[str, str]] = field(default_factory=dict)  # region name or code -> (region, country)


#: A small default; production gazetteers are loaded from tables.
DEFAULT = Gazetteer(
    countries={"france": "France", "fr": "France", "germany": "Germany", "de": "Germany", "spain": "Spain", "es": "Spain", "canada": "Canada", "ca": "Canada", "united kingdom": "United Kingdom", "uk": "United Kingdom", "gb": "United Kingdom", "netherlands": "Netherlands", "nl": "Netherlands", "united states": "United States", "usa": "United States", "us": "United States"},
    cities={"paris": "France", "lyon": "France", "berlin": "Germany", "munich": "Germany", "madrid": "Spain", "montreal": "Canada", "toronto": "Canada", "london": "United Kingdom", "amsterdam": "Netherlands", "san francisco": "United States", "new york": "United States"},
    regions={"quebec": ("Quebec", "Canada"), "qc": ("Quebec", "Canada"), "ontario": ("Ontario", "Canada"), "on": ("Ontario", "Canada"), "california": ("California", "United States"), "ca": ("California", "United States"), "ny": ("New York", "United States"), "bavaria": ("Bavaria", "Germany")},
)

MODES = [("remote", r"\b(?:fully remote|remote|telecommute|work from home|teletravail|home office|homeoffice)\b"), ("hybrid", r"\b(?:hybrid|hybride|partly remote|partial remote)\b"), ("onsite", r"\b(?:on-?site|in office|sur site|vor ort)\b")]
SCOPES = [("worldwide", r"\b(?:worldwide|anywhere|global)\b"), ("europe", r"\b(?:europe|eu|emea|eea)\b"), ("americas", r"\b(?:americas|latam|north america)\b")]


def work_mode(text: Column) -> Column:
    """remote, hybrid, onsite or null; hybrid wins over remote (LOC-03)."""
    t = F.lower(text)
    return F.when(t.rlike(MODES[1][1]), "hybrid").when(t.rlike(MODES[0][1]), "remote").when(t.rlike(MODES[2][1]), "onsite")


def scope_from_text(text: Column) -> Column:
    t = F.lower(text)
    out = None
    for name, pattern in SCOPES:
        out = F.when(t.rlike(pattern), name) if out is None else out.when(t.rlike(pattern), name)
    return out


def parse_place(raw: str, g: Gazetteer) -> tuple[str | None, str | None, str | None]:
    """(city, region, country) by a walk over the comma parts; a code that is a
    state and a country is settled by the city's country (LOC-02)."""
    parts = [p.strip().lower() for p in re.split(r"[,;|/()]| - ", raw) if p.strip()]
    if len(parts) == 1 and re.fullmatch(r"[a-z]{2}[.-][a-z .-]+", parts[0]):  # FR-Paris, FR.Paris
        parts = re.split(r"[.-]", parts[0], maxsplit=1)[::-1]
    city = next((p for p in parts if p in g.cities), None)
    near = g.cities.get(city) if city else None
    region = country = None
    for p in parts:
        if p == city:
            continue
        state, nation = g.regions.get(p), g.countries.get(p)
        if state and nation:
            state, nation = (state, None) if near == state[1] or not near and len(parts) > 1 and near != nation else (None, nation)
        if state and not region:
            region, country = state[0], country or state[1]
        elif nation and not country:
            country = nation
    return (city.title() if city else None), region, country or near


def parse_location_text(raw: str | None, remote: bool | None, workplace: str | None, g: Gazetteer = DEFAULT) -> dict:
    """The fields of a parsed location (LOC-01)."""
    text = raw or ""
    low = f"{text} {workplace or ''}".lower()
    hits = {name: bool(re.search(p, low)) for name, p in MODES}
    mode = "hybrid" if hits["hybrid"] else "remote" if hits["remote"] or remote else "onsite" if hits["onsite"] else None
    bare = re.sub("|".join(p for _, p in MODES), " ", text, flags=re.I)
    city, region, country = parse_place(bare, g)
    scope = next((name for name, p in SCOPES if re.search(p, low)), None)
    is_remote = True if mode == "remote" else remote if remote is not None else False if mode == "onsite" or city else None
    return {"raw": raw, "city": city, "region": region, "country": country, "remote": is_remote, "remote_scope": scope or (country if mode == "remote" and country else "unknown" if mode == "remote" else None), "work_mode": mode}


LOCATION = "raw string, city string, region string, country string, remote boolean, remote_scope string, work_mode string"


def parse_location(g: Gazetteer = DEFAULT):
    """LOC-01 as a column function of (raw, remote flag, workplace)."""

    def parse(raw: pd.Series, remote: pd.Series, workplace: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_location_text(r, None if pd.isna(m) else bool(m), w, g) for r, m, w in zip(raw, remote, workplace, strict=True)], columns=[c.split()[0] for c in LOCATION.split(", ")])

    return column_udf(parse, LOCATION)


def display(location: Column) -> Column:
    """City, region, country with the mode in front of remote places (LOC-04)."""
    place = F.concat_ws(", ", location["city"], location["region"], location["country"])
    return F.when(location["work_mode"] == "remote", F.when(F.length(place) > 0, F.concat(F.lit("Remote, "), place)).otherwise("Remote")).otherwise(place)
