"""Extraction profiles by kind of book, and the types of concepts they look for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of concepts by field (fixed values).
TYPES = {
    "general": "term method principle formula account",
    "science": "theory law process organism structure system unit",
    "agriculture": "practice crop breed pest tool nutrient",
    "computing": "algorithm data_structure model architecture protocol language parameter metric function pattern operator framework dataset",
    "veterinary": "disease symptom treatment vaccine drug pathogen condition anatomy procedure feed behavior",
}
ALL_TYPES = tuple(t for group in TYPES.values() for t in group.split())
#: Other names of the types (fixed values).
OTHER_NAMES = {
    "term": "definition concept vocabulary word terminology", "method": "technique approach strategy", "principle": "rule guideline", "formula": "calculation equation expression",
    "account": "ledger journal", "theory": "hypothesis", "law": "scientific_law", "process": "reaction cycle mechanism pathway", "organism": "species animal bacteria",
    "structure": "organ tissue cell molecule compound", "system": "ecosystem network", "unit": "measurement", "practice": "farming cultivation husbandry", "crop": "plant grain vegetable",
    "breed": "livestock variety", "pest": "insect weed blight", "tool": "equipment machine implement", "nutrient": "fertilizer mineral supplement",
    "algorithm": "sorting search optimization heuristic", "data_structure": "array tree graph list", "model": "neural_network classifier regressor transformer cnn rnn",
    "architecture": "design topology", "protocol": "standard specification", "language": "syntax programming", "parameter": "hyperparameter config setting",
    "metric": "score measure evaluation", "function": "activation loss", "pattern": "design_pattern", "framework": "library toolkit platform", "dataset": "corpus benchmark",
    "disease": "illness infection disorder", "symptom": "sign clinical_sign indicator", "treatment": "therapy", "drug": "medication medicine antibiotic pharmaceutical",
    "vaccine": "immunization vaccination", "pathogen": "virus microbe parasite infectious_agent", "condition": "syndrome state", "anatomy": "body_part morphology",
    "procedure": "surgery operation intervention", "feed": "nutrition diet ration forage", "behavior": "action habit instinct",
}


@dataclass(frozen=True)
class Profile:
    name: str
    title: str
    types: tuple[str, ...]
    hint: str = ""


def _profile(name: str, title: str, types: str, hint: str = "") -> Profile:
    return Profile(name, title, tuple(types.split()), hint)


#: Profiles and the types each looks for (fixed values); hints go to a provider that extracts.
PROFILES = {p.name: p for p in (
    _profile("general", "General", TYPES["general"]),
    _profile("programming", "CS / Programming", "term method algorithm data_structure pattern framework language protocol architecture function formula principle", "Keep code, commands and names of libraries as they are written."),
    _profile("erp", "ERP / Business", "term method principle formula account process system", "Name modules, document flows, accounts and key figures."),
    _profile("stem", "STEM / Science", "term method principle formula theory law process organism structure system unit", "Keep notation, units, named laws and species."),
    _profile("agriculture", "Agriculture / Farming", "term method principle practice crop breed pest tool nutrient system process", "Name practices, varieties, breeds, pests and yields."),
    _profile("veterinary", "Veterinary Science", "term method principle disease symptom treatment vaccine drug pathogen condition anatomy procedure feed behavior", "Name diseases with their agents and signs, doses and schedules."),
)}


def get_profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"no profile {name!r}; there are {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def list_profiles() -> list[str]:
    return sorted(PROFILES)


def concept_type(c: Column | str, profile: str | None = None) -> Column:
    """One of ALL_TYPES for a type as someone wrote it: letter case, hyphens and spaces don't matter, other names are
    mapped, unknown and null ones are ``term``. With a profile, types it doesn't look for are ``term`` too."""
    c = F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), "[- ]", "_")
    names = {t: t for t in ALL_TYPES} | {o: t for t, others in OTHER_NAMES.items() for o in others.split() if o not in ALL_TYPES}
    wanted = None if profile is None else get_profile(profile).types
    pairs = [F.lit(x) for kv in names.items() if wanted is None or kv[1] in wanted for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit("term"))
