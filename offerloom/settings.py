"""Selection profile: the parameters a user may change."""
from dataclasses import dataclass, field

from . import fixed_values as fv


@dataclass(frozen=True)
class Profile:
    brands: tuple = field(default_factory=lambda: tuple(fv.BRANDS))
    waist: tuple = field(default_factory=lambda: tuple(fv.WAIST_INCHES))
    inseam_max: int = fv.INSEAM_MAX
    min_discount: float = fv.MIN_DISCOUNT_PCT
    near_min: float = fv.NEAR_MIN_PCT
    near_limit: int = fv.NEAR_LIMIT
    excluded_terms: tuple = field(default_factory=lambda: tuple(fv.EXCLUDED_PRODUCT_TERMS))
    excluded_colours: tuple = field(default_factory=lambda: tuple(fv.EXCLUDED_COLOURS))
    preferred_colours: tuple = field(default_factory=lambda: tuple(fv.PREFERRED_COLOURS))


DEFAULT = Profile()
