"""Rules as data: word, size and card rules in tables, read when a query is built.

A rule table is a DataFrame that a user edits or loads; the default tables state the fixed rules in
the same form. `product_rules` and `size_rules` read a table into expressions that stay inside the
JVM: words become one pattern per rule, size rules a chain in the order of `pos`. A rule table is
settings, not data: at most MOST rows are read, more are an error and not cut."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..settings import DEFAULT, Profile
from . import sizes as sz
from .text import NOT_ASCII, any_of, blank, let, strip_marks, whole_word

c = F.col
MOST = 20_000
PRODUCT_RULES = "rule string, term string, points double"
SIZE_RULES = ("pos int, system string, pattern string, first_low int, first_high int, first_even boolean, first_in array<int>, "
              "second_low int, second_high int, size_class string")
CARD_RULES = "source_id string, element string, class_name string"


def _read(table: DataFrame) -> list:
    rows = table.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a rule table has at most {MOST} rows")
    return rows


# ---- F11, F15: words ------------------------------------------------------------------------------------
def product_rule_table(spark: SparkSession) -> DataFrame:
    """The fixed product rules: `needed`, `excluded` and `detail_excluded` are whole words, the
    `..._part` rules count anywhere; `term` excludes by its text; `fit`, with or without a term, adds
    points."""
    words = {"needed": fv.TROUSER_WORDS, "excluded": fv.EXCLUDED_WORDS, "excluded_part": fv.EXCLUDED_COMPOUNDS,
             "detail_excluded": fv.OTHER_WEARER_WORDS, "detail_excluded_part": fv.OTHER_SPORT_COMPOUNDS,
             "unsuitable_part": fv.FIT_HEAVY_WORDS, "term": fv.EXCLUDED_PRODUCT_TERMS}
    rows = [(rule, w, None) for rule, ws in words.items() for w in ws]
    rows += [("fit", None, float(fv.FIT_BASE))] + [("fit", w, float(fv.FIT_PLUS)) for w in fv.FIT_PLUS_WORDS]
    rows += [("fit", w, -float(fv.FIT_MINUS)) for w in fv.FIT_MINUS_WORDS]
    return spark.createDataFrame(rows, PRODUCT_RULES)


@dataclass
class ProductRules:
    words: dict = field(default_factory=dict)
    points: list = field(default_factory=list)

    def _matches(self, text: Column, whole: str | None = None, part: str | None = None) -> Column:
        patterns = [whole_word(self.words[whole])] if self.words.get(whole) else []
        patterns += [any_of(self.words[part])] if self.words.get(part) else []
        return text.rlike("|".join(patterns)) if patterns else F.lit(False)

    def is_eligible(self, name, description=None) -> Column:
        """F11 by the table."""
        title = F.lower(F.regexp_replace(blank(name), "[´`’‘]", "'"))
        detail = F.lower(blank(description if description is not None else F.lit("")))
        return (self._matches(title, "needed") & ~self._matches(title, "excluded", "excluded_part")
                & ~(title.rlike(NOT_ASCII) & self._matches(strip_marks(title), "excluded"))
                & ~self._matches(detail, "detail_excluded", "detail_excluded_part"))

    def product_fit(self, name, description) -> Column:
        """F15 by the table."""
        title = F.lower(blank(name))
        text = F.concat_ws(" ", title, F.lower(blank(description)))
        total = sum((F.when(text.contains(w), F.lit(p)).otherwise(F.lit(0.0)) if w else F.lit(p) for w, p in self.points), F.lit(0.0))
        unsuitable = self._matches(text, part="unsuitable_part")
        for term in self.words.get("term", ()):
            unsuitable = unsuitable | title.contains(term)
        return F.when(~self.is_eligible(name, description) | unsuitable, F.lit(0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)).cast("int"))


def product_rules(table: DataFrame) -> ProductRules:
    """Rules of a table (rule, term, points). A rule without rows never matches."""
    out = ProductRules()
    for r in sorted(_read(table.select("rule", "term", "points")), key=lambda r: (r.rule, r.term or "")):
        if r.rule == "fit":
            out.points.append((r.term, float(r.points or 0)))
        elif r.term:
            out.words.setdefault(r.rule, []).append(r.term)
    return out


# ---- F13: sizes -----------------------------------------------------------------------------------------
def _spread(word: str) -> str:
    """A word whose letters may stand apart."""
    return " *".join(word)


def size_rule_table(spark: SparkSession, profile: Profile = DEFAULT) -> DataFrame:
    """The fixed size rules of a profile. A rule answers for a cleaned label that its pattern
    matches, whose first number lies within first_low and first_high (and is even, and one of
    first_in) and whose second number lies within its bounds; the first rule by `pos` counts."""
    def some(words):
        return "(?:" + "|".join(words) + ")"
    waist, words = list(profile.waist), some(fv.SIZE_WAIST_WORDS)
    lengths = some([_spread(w) for w in fv.SIZE_LENGTH_WORDS if w])
    joint = rf"(?: *{some([m for m in fv.SIZE_PAIR_MARKS])} *{lengths}? *|(?=\D* ) *{lengths}? *)"
    pair = rf"^(?:{words}?\s*(\d\d){joint}(\d\d)|{words}\s*(\d\d)(?: *{some([_spread(w) for w in ('L', 'LENGTH')])} *)(\d\d))$"
    short = fv.SIZE_SHORT_MARKS
    short = rf"^(?:{some(short['before'])}\s*(\d\d)\s*|(\d\d)\s*{some(short['after'])}\s*)$"
    cut = rf"^{words}?\s*(\d\d)\s*(?:[-/]\s*)?"
    long_marks = some(fv.SIZE_LONG_MARKS)
    long_number = rf"^(?:DE|EU|{long_marks})?\s*(\d+)\s*{long_marks}?\s*$"
    plain, marked = r"^(\d\d)\s*$", rf"^{some(fv.SIZE_EU_MARKS)}?\s*(\d\d)\s*$"
    either = lambda mark: rf"^(?:{mark}\s*(\d\d)\s*|(\d\d)\s*{mark}\s*)$"
    none = dict(system=None, low=None, high=None, even=None, good=None, low2=None, high2=None)
    rules = [(p, k, none) for p, k in ((fv.SIZE_LONG_LETTER, sz.OTHER), (fv.SIZE_TARGET_LETTER, sz.TARGET), (fv.SIZE_NEAR_LETTER, sz.NEAR),
                                       (fv.SIZE_OTHER_LETTER, sz.OTHER), (r"^[2-6]?[^0-9]*$", sz.UNKNOWN))]

    def add(pattern, size_class, **limits):
        rules.append((pattern, size_class, none | limits))

    def near_if(pattern, good, **limits):
        add(pattern, sz.NEAR, good=good, **limits)
        add(pattern, sz.OTHER, **limits)
    add(pair, sz.TARGET, low=26, high=48, good=waist, low2=26, high2=min(38, profile.inseam_max))
    add(pair, sz.OTHER, low=26, high=48, low2=26, high2=38)
    near_if(short, [25, 26], high=31)
    fitting = [w for w in fv.SIZE_WAIST_CUTS if w not in fv.SIZE_WAIST_LONG_CUTS]
    add(cut + some(fitting) + r"\s*$", sz.TARGET, low=26, high=48, good=waist)
    add(cut + some(fv.SIZE_WAIST_CUTS) + r"\s*$", sz.OTHER, low=26, high=48)
    near_if(rf"^(?:{words}|UK|US)\s*(\d\d)\s*$", waist)
    add(long_number, sz.OTHER, low=90, high=118, even=True)
    near_if(either("FR"), [44])
    near_if(either("IT"), [50, 52])
    add(r"^D\s*(\d+)\s*$", sz.OTHER, low=90, high=119, even=True)
    add(plain, sz.NEAR, good=waist)
    add(plain, sz.NEAR, system="fr", good=[44, 46])
    add(plain, sz.OTHER, system="fr", low=34, high=58)
    add(plain, sz.UNKNOWN, system="fr")
    add(marked, sz.NEAR, good=[50, 52])
    add(marked, sz.OTHER, low=42, high=64, even=True)
    add(plain, sz.UNKNOWN, good=[25, 26])
    add(plain, sz.OTHER, low=24, high=40)
    rows = [(k, n["system"], p, n["low"], n["high"], n["even"], n["good"], n["low2"], n["high2"], label) for k, (p, label, n) in enumerate(rules)]
    return spark.createDataFrame(rows, SIZE_RULES)


def _number(text: Column, pattern: str, groups) -> Column:
    """The first of the groups that holds a number."""
    return F.coalesce(*[F.regexp_extract(text, pattern, g).try_cast("int") for g in groups])


def size_rules(table: DataFrame):
    """A function (label, system) -> class by a table of SIZE_RULES. A rule's pattern has its first
    number in the odd groups and its second in the even ones if `second_...` is given, else its
    first number in any group."""
    import re
    rules = sorted(_read(table), key=lambda r: r.pos)

    def classify(text: Column, system: Column) -> Column:
        out = []
        for r in rules:
            groups = re.compile(r.pattern).groups
            two = r.second_low is not None or r.second_high is not None
            n = _number(text, r.pattern, range(1, groups + 1, 2 if two else 1)) if groups else F.lit(None).cast("int")
            fits = text.rlike(r.pattern)
            if r.system is not None:
                fits = fits & (system == r.system)
            if r.first_low is not None:
                fits = fits & (n >= r.first_low)
            if r.first_high is not None:
                fits = fits & (n <= r.first_high)
            if r.first_even:
                fits = fits & (n % 2 == 0)
            if r.first_in is not None:
                fits = fits & n.isin(*r.first_in)
            if two:
                m = _number(text, r.pattern, range(2, groups + 1, 2))
                fits = fits & m.between(-(1 << 31) if r.second_low is None else r.second_low, (1 << 31) - 1 if r.second_high is None else r.second_high)
            out.append(F.when(fits, F.lit(r.size_class)))
        return F.coalesce(*out, F.lit(sz.UNKNOWN))

    def label_class(label: Column, system="de") -> Column:
        system = F.lit(system) if isinstance(system, str) else system
        return F.when(sz.squeeze(label) == "", F.lit(sz.UNKNOWN)).otherwise(
            let(sz.cleaned(label), lambda known: F.coalesce(known["verdict"], classify(known["text"], system))))
    return label_class


# ---- S11: cards -----------------------------------------------------------------------------------------
def card_rule_table(spark: SparkSession) -> DataFrame:
    """The fixed class names of shops whose cards the general rules miss."""
    return spark.createDataFrame([(s, e, k) for s, own in fv.CARD_RULES.items() for e, k in own.items()], CARD_RULES)
