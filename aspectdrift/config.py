"""Dimensions and defaults of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Window, taxonomy, priors, strata and cohorts.
WINDOW = ("2022-03", "2025-02")
CATEGORIES = ("FACILITY", "AMENITY", "SERVICE", "EXPERIENCE", "LOYALTY", "BRANDING")
CODES = {
    "FACILITY": ("FAC_ROOM", "FAC_VIEW_LOCATION", "FAC_BUILDING", "FAC_BATH", "FAC_ENV", "FAC_INTERIOR", "FAC_CLIMATE", "FAC_SECURITY"),
    "AMENITY": ("AM_POOL", "AM_FOOD", "AM_ROOM_UTIL", "AM_TRANSPORT", "AM_WELLNESS", "AM_ENT", "AM_WIFI", "AM_UTILITY"),
    "SERVICE": ("SER_ATTITUDE", "SER_SUPPORT", "SER_OPERATION", "SER_COMM", "SER_PROFESSIONALISM"),
    "EXPERIENCE": ("EXP_OVERALL", "EXP_VALUE", "EXP_EMOTION", "EXP_SAFETY"),
    "LOYALTY": ("LOY_RETURN", "LOY_RECOMMEND", "LOY_PREFERENCE"),
    "BRANDING": ("BRA_CONSISTENCY", "BRA_LUXURY", "BRA_REPUTE"),
}
REPORTABLE = (
    "FAC_ROOM", "FAC_VIEW_LOCATION", "AM_POOL", "FAC_BUILDING", "SER_ATTITUDE", "AM_FOOD", "FAC_BATH",
    "EXP_OVERALL", "AM_ROOM_UTIL", "FAC_ENV", "LOY_RETURN", "FAC_INTERIOR", "EXP_VALUE", "SER_SUPPORT",
)
SENTIMENTS = ("positive", "neutral", "negative")
PROVENANCE_PRIOR = {"POS": (0.931, 0.036, 0.033), "NEG": (0.217, 0.142, 0.641)}
PROVENANCE_LAMBDA = 0.7
WEST = (
    "pháp", "úc", "đức", "vương quốc anh", "mỹ", "tây ban nha", "hà lan", "ý", "bỉ", "canada", "thụy sĩ", "thuỵ sĩ",
    "áo", "đan mạch", "thụy điển", "thuỵ điển", "na uy", "ireland", "new zealand", "ba lan", "séc", "bồ đào nha", "phần lan",
)
ASIA = (
    "nhật bản", "hàn quốc", "trung quốc", "thái lan", "singapore", "malaysia", "đài loan", "hồng kông",
    "indonesia", "philippines", "ấn độ", "campuchia", "lào",
)
HOME = "việt nam"
TRAVELLERS = ("Cặp đôi", "Phòng gia đình", "Khách lẻ", "Nhóm", "NA")
LENGTH_BINS = (15, 45)
PRIOR_SHARE, PRIOR_VALENCE = 30.0, 10.0
DEFAULT_SCORE = 8.7
SEED, ALPHA, PERMUTATIONS = 20260821, 0.05, 1000
COHORTS = {
    "A-dense": {"min_pool": 1000, "split": None},
    "B-anchor": {"min_pool": 300, "split": None},
    "T-unbiased": {"min_pool": 0, "split": "test"},
}


def code_to_category() -> dict[str, str]:
    return {code: cat for cat, codes in CODES.items() for code in codes}


@dataclass
class EngineConfig:
    """Settings of one run; written beside its results."""

    window: tuple[str, str] = WINDOW
    level: str = "taxonomy_code"
    prior_share: float = PRIOR_SHARE
    prior_valence: float = PRIOR_VALENCE
    permutations: int = PERMUTATIONS
    bootstraps: int = 0
    alpha: float = ALPHA
    seed: int = SEED
    provenance_lambda: float = PROVENANCE_LAMBDA
    work_dir: str = "outputs"
    notes: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> str:
        """Where a named table of this run lives."""
        return f"{self.work_dir.rstrip('/')}/{name}"
