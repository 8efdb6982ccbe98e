"""Settings of a run. Everything that a query depends on is here and is passed in; nothing is read from the clock."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from datetime import date
from pathlib import Path

# Search terms, vocabularies, excluded employers and parameters of requests that results depend on.
BOARD_QUERIES = (
    "studentermedhjælper data", "student assistant data", "studentermedhjælper IT", "student assistant IT",
    "data analyst student", "data engineer student", "business intelligence student", "machine learning student",
    "AI student assistant", "generative AI student", "LLM student", "junior data analyst", "data scientist student",
    "IT support student", "software student", "student developer", "python student", "studentermedhjælper udvikler",
    "devops student", "cloud student", "infrastructure student", "automation student", "office assistant",
    "office coordinator", "kontorassistent", "workplace coordinator", "logistics coordinator student",
)
API_QUERIES = ("data", "machine learning", "AI", "LLM", "data engineer", "software", "python", "devops", "infrastructure", "cloud", "automation", "IT support", "student", "office", "operations")
EXCLUDED_COMPANIES = ("københavns kommune", "copenhagen municipality", "kbh kommune", "kommune", "politi", "forsvaret")
TECH_TERMS = (
    "data", "python", "sql", "analyt", "analyst", "business intelligence", " bi ", "machine learning", " ml ", "mlops",
    " ai ", "artificial intelligence", "nlp", "llm", "rag", "ollama", "generativ", "generative", "computer vision",
    "it support", "it-support", "servicedesk", "service desk", "software", "developer", "udvikler", "programmør",
    "engineer", "etl", "pipeline", "automation", "automatisering", "devops", "backend", "infrastructure",
    "infrastruktur", "platform", "cloud", "kubernetes", "docker", "linux", "data scientist", "data engineer",
    "forecast", "forecasting",
)
BRIDGE_TERMS = (
    "office assistant", "office coordinator", "office manager", "kontorassistent", "workplace", "facilit", "reception",
    "front desk", "logistic", "logistik", "koordinator", "coordinator", "operations", "administrativ", "support",
)
EXCLUDE_TERMS = ("hr ", "human resources", "recruit", "rekrutter", "marketing", "markedsføring")
ACCEPTED_TYPES = ("student", "part_time", "internship", "unknown")
TRACKS = ("A", "B", "none")
EMPLOYMENT_TYPES = ("student", "part_time", "internship", "full_time", "unknown")
WORK_MODES = ("onsite", "hybrid", "remote", "unknown")
BODY_SOURCES = ("full", "snippet")
STATUSES = ("interested", "applied", "interview", "offer", "rejected", "skipped")


@dataclass(frozen=True)
class Settings:
    today: date
    max_days_old: int = 8
    max_pages: int = 5
    score_threshold: int = 75
    accepted_types: tuple[str, ...] = ACCEPTED_TYPES
    require_commutable: bool = True
    exclude_language_required: bool = True
    fresh_days: int = 21
    fetch_bodies: bool = True
    drop_foreign_language: bool = False
    score_workers: int = 4
    fetch_workers: int = 3
    tech_terms: tuple[str, ...] = TECH_TERMS
    bridge_terms: tuple[str, ...] = BRIDGE_TERMS
    exclude_terms: tuple[str, ...] = EXCLUDE_TERMS
    excluded_companies: tuple[str, ...] = EXCLUDED_COMPANIES
    board_queries: tuple[str, ...] = BOARD_QUERIES
    api_queries: tuple[str, ...] = API_QUERIES
    candidate_profile: str = ""
    location_anchor: str = ""
    base: str = "."
    board_url: str = ""
    board_base: str = ""
    api_url: str = ""
    api_job_url: str = ""
    api_search_param: str = "search"
    api_page_param: str = "page"
    api_zero_indexed: bool = False
    api_params: tuple[tuple[str, str], ...] = (("countryCode", "DK"), ("sorting", "mostPopular"))

    @property
    def include_terms(self) -> tuple[str, ...]:
        return self.tech_terms + self.bridge_terms


@dataclass(frozen=True)
class Profile:
    """One person's overrides, from a TOML file."""

    name: str
    candidate_profile: str
    location_anchor: str
    queries: tuple[str, ...] = field(default=())
    excluded_companies: tuple[str, ...] | None = None
    danish_ok: bool = False
    require_commutable: bool | None = None


def load_profile(folder: str, name: str) -> Profile:
    """The profile name.toml of a folder. A missing one ends with the names there are; those beginning with _ are none."""
    path = Path(folder, f"{name}.toml")
    if not path.is_file():
        known = sorted(p.stem for p in Path(folder).glob("*.toml") if not p.stem.startswith("_"))
        raise SystemExit(f"no profile {name!r}; there are: {', '.join(known) or 'none'}")
    got = tomllib.loads(path.read_text(encoding="utf-8"))
    for key in ("candidate_profile", "location_anchor"):
        if key not in got:
            raise SystemExit(f"profile {name!r} lacks {key}")
    return Profile(got.get("name", name), got["candidate_profile"], got["location_anchor"], tuple(got.get("queries", ())), tuple(got["excluded_companies"]) if "excluded_companies" in got else None, bool(got.get("danish_ok", False)), got.get("require_commutable"))


def with_profile(settings: Settings, profile: Profile, owner: bool = False) -> Settings:
    """Settings under a profile; anyone but the owner works below their own folder."""
    changes: dict = {"candidate_profile": profile.candidate_profile, "location_anchor": profile.location_anchor}
    if profile.queries:
        changes["board_queries"] = profile.queries
    if profile.excluded_companies is not None:
        changes["excluded_companies"] = profile.excluded_companies
    if profile.require_commutable is not None:
        changes["require_commutable"] = profile.require_commutable
    if profile.danish_ok:
        changes["exclude_language_required"] = False
    if not owner:
        changes["base"] = f"{settings.base}/_profiles/{profile.name}"
    return replace(settings, **changes)
