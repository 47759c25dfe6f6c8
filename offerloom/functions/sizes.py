"""Size labels: F13 normalize_size, F14 size_evidence, F9 expand_size_ranges, F35 size_label_map."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..settings import DEFAULT, Profile
from .text import EDGE, SPACE, blank, let, squeeze

TARGET, NEAR, OTHER, UNKNOWN = "target", "near", "incompatible", "unknown"


def _clean(label) -> Column:
    """Upper case without size words, inch marks and region suffixes."""
    c = squeeze(F.upper(blank(label)))
    c = F.regexp_replace(c, fv.SIZE_PREFIX_PATTERN, "")
    return F.trim(F.regexp_replace(c, f"(?:{fv.SIZE_INCH_SUFFIX_PATTERN})", ""))


def _resolve_cut(c) -> Column:
    """"52 - Regular (EU)" -> "52"; a long cut is judged at once; "L (52)" -> "L"."""
    c = F.when(c.contains("("), F.trim(F.regexp_replace(c, fv.SIZE_REGION_SUFFIX_PATTERN, ""))).otherwise(c)
    cut = rf"^(.+?)\s*-\s*({'|'.join(fv.SIZE_CUTS)})$"
    letter_first = rf"^({'|'.join(fv.SIZE_LETTERS)})\s*(?:\(|/\s*(?:EU|DE)(?![A-Za-z0-9_])).*$"

    def split_cut(x):
        base = F.trim(F.regexp_extract(x, cut, 1))
        is_long = F.regexp_extract(x, cut, 2).isin(*fv.SIZE_LONG_CUTS)
        return F.when(base != "", F.struct(base.alias("text"), F.when(is_long, F.when(
            base.rlike(r"^(?:(?:EU|DE)\s*)?\d{2}$|^L$"), F.lit(OTHER)).otherwise(F.lit(UNKNOWN))).alias("verdict")))

    whole = F.struct(c.alias("text"), F.lit(None).cast("string").alias("verdict"))
    out = F.coalesce(F.when(c.contains("-"), split_cut(c)), whole)
    return F.when(c.rlike(r"[(/]"), F.struct(
        F.regexp_replace(out["text"], letter_first, "$1").alias("text"), out["verdict"].alias("verdict"))).otherwise(out)


def cleaned(label) -> Column:
    """The label as the rules read it: struct(text, verdict), the verdict of a cut that decides alone."""
    return _resolve_cut(_clean(label))


def _letters(text: Column) -> Column:
    return (F.when(text.rlike(fv.SIZE_LONG_LETTER), F.lit(OTHER))
            .when(text.rlike(fv.SIZE_TARGET_LETTER), F.lit(TARGET))
            .when(text.rlike(fv.SIZE_NEAR_LETTER), F.lit(NEAR))
            .when(text.rlike(fv.SIZE_OTHER_LETTER), F.lit(OTHER))
            .otherwise(F.lit(UNKNOWN)))


def _near_if(n, good) -> Column:
    return F.when(n.isin(*good), F.lit(NEAR)).otherwise(F.lit(OTHER))


def _numbers(p: Column, system: Column, profile: Profile) -> Column:
    """The rule table for labels with a number, split into [before, number, between, number,
    after]. Rules compare these pieces; the first rule that answers counts."""
    before, between = F.trim(p[0]), F.trim(p[2])
    n, m = p[1].try_cast("int"), p[3].try_cast("int")
    two, one = F.length(p[1]) == 2, (p[3] == "") & (p[4] == "")
    bare = one & (between == "")
    waist_word = before.isin(*fv.SIZE_WAIST_WORDS)
    maybe_waist = waist_word | (before == "")
    joint = F.replace(p[2], F.lit(" "), F.lit(""))
    pair = (two & (F.length(p[3]) == 2) & (p[4] == "") & maybe_waist & (
        joint.isin(*[s + w for s in fv.SIZE_PAIR_MARKS for w in fv.SIZE_LENGTH_WORDS])
        | (p[2].contains(" ") & joint.isin(*fv.SIZE_LENGTH_WORDS))
        | (waist_word & joint.isin("L", "LENGTH"))))
    cut = F.regexp_replace(between, r"^[-/]\s*", "")
    fits = lambda w: w.isin(*profile.waist)
    mark = fv.SIZE_SHORT_MARKS
    short = two & one & ((before.isin(*mark["before"]) & (between == "")) | ((before == "") & between.isin(*mark["after"])))
    long_number = (bare | one & between.isin(*fv.SIZE_LONG_MARKS)) & before.isin("", "DE", "EU", *fv.SIZE_LONG_MARKS)
    plain = two & bare & before.isin("", *fv.SIZE_EU_MARKS)
    unmarked = before == ""
    rules = [
        F.when(pair & n.between(26, 48) & m.between(26, 38),
               F.when(fits(n) & (m <= profile.inseam_max), F.lit(TARGET)).otherwise(F.lit(OTHER))),
        F.when(short & (n <= 31), _near_if(n, [25, 26])),
        F.when(two & one & maybe_waist & n.between(26, 48) & cut.isin(*fv.SIZE_WAIST_CUTS),
               F.when(fits(n) & ~cut.isin(*fv.SIZE_WAIST_LONG_CUTS), F.lit(TARGET)).otherwise(F.lit(OTHER))),
        F.when(two & bare & (waist_word | before.isin("UK", "US")), _near_if(n, profile.waist)),
        F.when(long_number & n.between(90, 118) & (n % 2 == 0), F.lit(OTHER)),
        F.when(two & one & F.concat(before, between).isin("FR"), _near_if(n, [44])),
        F.when(two & one & F.concat(before, between).isin("IT"), _near_if(n, [50, 52])),
        F.when(bare & (before == "D") & n.between(90, 119) & (n % 2 == 0), F.lit(OTHER)),
        F.when(plain & unmarked & fits(n), F.lit(NEAR)),
        F.when(plain & unmarked & (system == "fr"), F.when(n.isin(44, 46), F.lit(NEAR))
               .when(n.between(34, 58), F.lit(OTHER)).otherwise(F.lit(UNKNOWN))),
        F.when(plain & n.isin(50, 52), F.lit(NEAR)),
        F.when(plain & n.between(42, 64) & (n % 2 == 0), F.lit(OTHER)),
        F.when(plain & unmarked & n.between(24, 40) & ~n.isin(25, 26), F.lit(OTHER)),
    ]
    return F.coalesce(*rules, F.lit(UNKNOWN))


_PIECES = r"^(\D*)(\d+)(\D*)(\d*)(.*)$"


def classify_sizes(sizes: Column, system="de", profile: Profile = DEFAULT) -> Column:
    """F13 over an array: one class per non-blank label. The steps are chained
    transforms, so every step is evaluated once per label."""
    system = F.lit(system) if isinstance(system, str) else system
    labels = F.filter(sizes, lambda s: squeeze(s) != "")
    steps = F.transform(F.transform(labels, _clean), _resolve_cut)
    pieces = F.transform(steps, lambda s: F.struct(
        s["text"].alias("text"), s["verdict"].alias("verdict"),
        F.split(F.regexp_replace(s["text"], _PIECES, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001").alias("p")))
    return F.transform(pieces, lambda s: F.coalesce(
        s["verdict"], F.when(s["text"].rlike(r"^[2-6]?[^0-9]*$"), _letters(s["text"]))
        .otherwise(_numbers(s["p"], system, profile))))


def normalize_size(label: Column, system="de", profile: Profile = DEFAULT) -> Column:
    """target, near, incompatible or unknown."""
    return F.coalesce(F.get(classify_sizes(F.array(label), system, profile), F.lit(0)), F.lit(UNKNOWN))


def evidence_of(classes: Column) -> Column:
    """F14 on an already classified array."""
    return (F.when(F.coalesce(F.size(classes), F.lit(0)) <= 0, F.lit("unconfirmed"))
            .when(F.array_contains(classes, TARGET), F.lit("confirmed"))
            .when(F.array_contains(classes, NEAR), F.lit("probable"))
            .when(F.forall(classes, lambda c: c == OTHER), F.lit("no"))
            .otherwise(F.lit("unconfirmed")))


def size_evidence(sizes: Column, system="de", profile: Profile = DEFAULT) -> Column:
    """confirmed, probable, no or unconfirmed."""
    return let(classify_sizes(sizes, system, profile), evidence_of)


def size_system(country: Column) -> Column:
    """French shops number trousers differently."""
    return F.when(country == "FR", F.lit("fr")).otherwise(F.lit("de"))


def expand_size_ranges(text: Column) -> Column:
    """sizes that "S-4XL", "XS bis XL" or "46 - 56" stand for."""
    letters = F.array(*[F.lit(x) for x in fv.RANGE_LETTERS])
    letter = "(" + "|".join(fv.RANGE_LETTERS).replace("XXL", "XXL|2XL") + ")"
    number = "(4[0-9]|5[0-9]|6[0-4])"
    to = rf"{SPACE}*(?:-|–|(?i:bis)){SPACE}*"
    letter_range = f"{EDGE}(?i:{letter}{to}{letter}){EDGE}"
    number_range = f"{EDGE}{number}{to}{number}{EDGE}"

    def ends(pattern, group):
        return F.regexp_extract_all(blank(text), F.lit(pattern), F.lit(group))

    def position(x):
        return F.array_position(letters, F.replace(F.upper(x), F.lit("2XL"), F.lit("XXL"))).cast("int")

    def letter_slice(a, b):
        i, j = position(a), position(b)
        return F.when((i > 0) & (j >= i), F.slice(letters, i, F.greatest(j - i + 1, F.lit(1)))) \
            .otherwise(F.array().cast("array<string>"))

    def number_steps(a, b):
        i, j = a.cast("int"), b.cast("int")
        return F.when(i <= j, F.transform(F.sequence(i, F.greatest(i, j), F.lit(2)), lambda n: n.cast("string"))) \
            .otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(
        F.flatten(F.zip_with(ends(letter_range, 1), ends(letter_range, 2), letter_slice)),
        F.flatten(F.zip_with(ends(number_range, 1), ends(number_range, 2), number_steps))))


def size_label_map(sizes: Column, mapping: Column) -> Column:
    """"3" -> "L (3)" for shops with their own size numbers."""
    return F.transform(sizes, lambda s: let(F.struct(
        F.trim(s).alias("own"), F.try_element_at(mapping, F.trim(s)).alias("letter")),
        lambda p: F.coalesce(F.concat(p["letter"], F.lit(" ("), p["own"], F.lit(")")), s)))
