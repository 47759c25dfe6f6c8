"""Text rules: cleaning, folding, word lists, product and colour rules."""
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

# A word edge between an ASCII word character and anything else. The word lists were
# written for that meaning; Java's \b also counts letters such as "á" as word characters.
EDGE = (r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")
NOT_ASCII = r"[^\x00-\x7f]"
SPACE = r"[\s\u00a0\u202f]"


def any_of(parts) -> str:
    """One alternation of the parts. Parts with the same first letter share a branch, so the
    matcher rejects most positions after one character."""
    branches, rest = {}, []
    for part in parts:
        if part[0].isalnum() and "|" not in part and part[1:2] not in ("?", "*", "+", "{"):
            branches.setdefault(part[0], []).append(part[1:])
        else:
            rest.append(part)
    rest += [f"{first}(?:{'|'.join(tails)})" for first, tails in branches.items()]
    return "(?:" + "|".join(rest) + ")"


def whole_word(parts) -> str:
    """Whole words in lower-case text. Where a word starts with an ASCII letter, a word edge is
    the same as no word character in front; only other words need the general edge."""
    plain = [p for p in parts if p[0].isascii() and (p[0].isalnum() or p.startswith("(?:"))]
    other = [p for p in parts if p not in plain]
    out = "(?<![A-Za-z0-9_])" + any_of(plain) + EDGE if plain else ""
    return out + ("|" if plain and other else "") + (EDGE + any_of(other) + EDGE if other else "")


def edges(pattern: str) -> str:
    """Give `\\b` inside a stated pattern the ASCII meaning."""
    return pattern.replace(r"\b", EDGE)


def blank(c) -> Column:
    return F.coalesce(c, F.lit(""))


def or_null(c) -> Column:
    """Empty text counts as missing."""
    return F.when(c != "", c)


def let(value: Column, use) -> Column:
    """Compute `value` once and use it several times in one expression."""
    return F.transform(F.array(value), use)[0]


def computed(df, columns: dict):
    """Add columns that are evaluated exactly once per row, in generated code. A projection computes them and a one-row
    generator passes them on, so a filter or projection above reads the result; with plain projections the
    optimizer would push a filter below them and repeat long expressions inside it."""
    held = df.withColumns({f"_held_{k}": v for k, v in columns.items()})
    row = F.struct(*[F.col(f"_held_{k}").alias(f"_new_{k}") for k in columns])
    return held.select(*df.columns, F.inline(F.array(row))).drop(*columns).withColumnsRenamed(
        {f"_new_{k}": k for k in columns})


def squeeze(c) -> Column:
    return F.regexp_replace(F.regexp_replace(blank(c), f"{SPACE}+", " "), "^ | $", "")


def clean_text(c) -> Column:
    """F8: tags become spaces, white space is collapsed."""
    return squeeze(F.regexp_replace(blank(c), "<[^>]+>", " "))


def decode_entities(c) -> Column:
    out = blank(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'"), ("&amp;", "&")):
        out = F.regexp_replace(out, entity, char)
    return out


def post_text(c) -> Column:
    """F8 for posts: line breaks, paragraphs and list items also separate words."""
    spaced = F.regexp_replace(blank(c), r"(?i)<br\s*/?>|</(?:p|li)>", " ")
    return squeeze(decode_entities(F.regexp_replace(spaced, "<[^>]*>", " ")))


def _marked_letters(form: str):
    """Letters whose decomposition is one base letter plus combining marks."""
    src, dst = [], []
    for code in range(0xC0, 0x2000):
        char = chr(code)
        base = "".join(x for x in unicodedata.normalize(form, char) if not "\u0300" <= x <= "\u036f")
        if len(base) == 1 and base != char:
            src.append(char)
            dst.append(base)
    return "".join(src), "".join(dst)


_LETTERS = {form: _marked_letters(form) for form in ("NFD", "NFKD")}


def beyond_ascii(c) -> Column:
    """Some character takes more than one byte; counting is much cheaper than a pattern."""
    return F.octet_length(c) != F.length(c)


def strip_marks(c, form: str = "NFD") -> Column:
    src, dst = _LETTERS[form]
    folded = F.regexp_replace(F.translate(c, src, dst), r"[\u0300-\u036f]", "")
    return F.when(beyond_ascii(c), folded).otherwise(c)


def fold(c, o_slash: bool = True, ae: bool = True, form: str = "NFD") -> Column:
    """lower case without diacritics; ø, æ and curly apostrophes on request. Plain ASCII has none of them."""
    low = F.lower(blank(c))
    out = strip_marks(F.regexp_replace(low, "’", "'"), form)
    src, dst = ("ø", "o") if o_slash else ("", "")
    if src:
        out = F.translate(out, src, dst)
    return F.when(beyond_ascii(low), F.replace(out, F.lit("æ"), F.lit("ae")) if ae else out).otherwise(low)


def fold_py(text: str, o_slash: bool = True) -> str:
    """The same folding for driver-side parameters (brand lists)."""
    low = unicodedata.normalize("NFD", text.lower().replace("’", "'"))
    low = "".join(x for x in low if not "\u0300" <= x <= "\u036f").replace("æ", "ae")
    return low.replace("ø", "o") if o_slash else low


def strip_title_badge(c) -> Column:
    """a discount badge glued to the front of a title."""
    return squeeze_ends(F.regexp_replace(
        c, rf"(?i)^{SPACE}*(?:bis{SPACE}+(?:zu{SPACE}+)?)?[-–]?{SPACE}*\d{{1,2}}{SPACE}*%{SPACE}+", ""))


def strip_temperature(c) -> Column:
    """a community temperature in front of a post title."""
    return squeeze_ends(F.regexp_replace(c, r"^-?\d+°\s*-\s*", ""))


def squeeze_ends(c) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_eligible(name, description=None) -> Column:
    """a trouser word in the title and nothing that rules the product out."""
    title = F.lower(F.regexp_replace(blank(name), "[´`’‘]", "'"))
    detail = F.lower(blank(description if description is not None else F.lit("")))
    other = whole_word(fv.OTHER_WEARER_WORDS) + "|" + any_of(fv.OTHER_SPORT_COMPOUNDS)
    return (title.rlike(whole_word(fv.TROUSER_WORDS))
            & ~title.rlike(whole_word(fv.EXCLUDED_WORDS) + "|" + any_of(fv.EXCLUDED_COMPOUNDS))
            & ~(beyond_ascii(title) & strip_marks(title).rlike(whole_word(fv.EXCLUDED_WORDS)))
            & ~detail.rlike(other))


def is_relevant_category(name, category, gender, tags) -> Column:
    """F11 for structured feeds: gender and category decide, never the description."""
    n, c, g, t = (F.lower(blank(x)) for x in (name, category, gender, tags))
    men = g.contains("herren") | g.contains("unisex") | c.startswith("herren >")
    trousers = n.rlike(whole_word(fv.CATEGORY_TROUSER_WORDS)) | F.concat_ws(" ", c, t).rlike(
        any_of(fv.CATEGORY_TROUSER_PATHS))
    out = any_of(fv.CATEGORY_EXCLUDED) + "|" + any_of(fv.CATEGORY_EXCLUDED_WORD_END) + EDGE
    return men & trousers & ~F.concat_ws(" ", n, c, t).rlike(out)


def is_product_text(c) -> Column:
    """F11 for listing texts."""
    low = F.lower(blank(c))
    out = any_of(fv.LISTING_EXCLUDED_PARTS) + "|" + any_of(fv.LISTING_EXCLUDED_WORD_END) + EDGE
    return low.rlike(any_of(fv.LISTING_TROUSER_PARTS)) & ~low.rlike(out)


def product_fit(name, description, eligible=None, terms=None) -> Column:
    """0-100; 0 when the product is not eligible or explicitly unsuitable."""
    terms = fv.EXCLUDED_PRODUCT_TERMS if terms is None else terms
    title = F.lower(blank(name))
    text = F.concat_ws(" ", title, F.lower(blank(description)))
    plus = sum((text.contains(w).cast("int") for w in fv.FIT_PLUS_WORDS), F.lit(0)) * fv.FIT_PLUS
    minus = sum((text.contains(w).cast("int") for w in fv.FIT_MINUS_WORDS), F.lit(0)) * fv.FIT_MINUS
    unsuitable = text.rlike(any_of(fv.FIT_HEAVY_WORDS))
    for term in terms:
        unsuitable = unsuitable | title.contains(term)
    eligible = is_eligible(name, description) if eligible is None else eligible
    return (F.when(~eligible | unsuitable, F.lit(0))
            .otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.lit(fv.FIT_BASE) + plus - minus))))


def colour_excluded(color, words=None) -> Column:
    """F30."""
    return F.lower(blank(color)).rlike(any_of(words or fv.EXCLUDED_COLOURS))


def colour_bonus(color, words=None) -> Column:
    return F.when(F.lower(blank(color)).rlike(any_of(words or fv.PREFERRED_COLOURS)),
                  F.lit(fv.COLOUR_BONUS)).otherwise(F.lit(0))


def is_sold_out(availability) -> Column:
    """F29."""
    return F.lower(blank(availability)).rlike(fv.SOLD_OUT_PATTERN)


def availability_tail(c) -> Column:
    """"https://schema.org/InStock" -> "InStock"."""
    return F.coalesce(or_null(F.element_at(F.split(clean_text(c), "/"), -1)), F.lit("unknown"))


def name_words(c) -> Column:
    """Words of a name of more than two letters, each once."""
    return F.filter(F.array_distinct(F.split(fold(c, ae=False), "[^a-z0-9]+")), lambda w: F.length(w) > 2)


def name_similarity(a, b) -> Column:
    """shared words of more than two letters, relative to the shorter name."""
    return let(F.struct(name_words(a).alias("a"), name_words(b).alias("b")), lambda p: F.when(
        (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0),
        F.size(F.array_intersect(p["a"], p["b"])) / F.least(F.size(p["a"]), F.size(p["b"])))
        .otherwise(F.lit(0.0)))


def similar_name(a, b) -> Column:
    return name_similarity(a, b) >= 0.6


def quoted(term: str) -> str:
    return "".join(x if x.isalnum() or x == " " else "\\" + x for x in term)


def brand_of_field(brand, brands) -> Column:
    """The profile brand equal to the brand field, earliest profile entry first."""
    table = {}
    for b in brands:
        table.setdefault(fold_py(b).strip(), b)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, F.trim(fold(brand)))


def brand_in_title(folded_title, brands) -> Column:
    """The first profile brand that stands in the folded title as a whole token. Names are only
    looked at, so overlapping ones are all found."""
    terms = [quoted(fold_py(b).strip()) for b in brands]
    names = {}
    for b in brands:
        names.setdefault(fold_py(b).strip(), b)
    found = F.regexp_extract_all(folded_title, F.lit(f"(?<![a-z0-9])(?=({any_of(terms)})(?![a-z0-9]))"), F.lit(1))
    order = F.array(*[F.lit(t) for t in names])
    labels = F.array(*[F.lit(b) for b in names.values()])
    return F.get(labels, F.array_min(F.transform(found, lambda t: F.array_position(order, t).cast("int"))) - 1)


def match_brand(brand, name, brands) -> Column:
    """brand field first, then the title; '' when no profile brand is found."""
    return F.coalesce(brand_of_field(brand, brands), brand_in_title(F.trim(fold(name)), brands), F.lit(""))


def brand_contained(text, brands) -> Column:
    """F12, substring variant of listing texts: first profile brand inside the folded text."""
    folded, low = fold(text), F.lower(blank(text))
    chain = [F.when(folded.contains(fold_py(b)), F.lit(b)) for b in brands]
    chain += [F.when(low.contains("".join(x for x in b.lower() if x.isascii() and x.isalnum())), F.lit(b))
              for b in brands]
    return F.coalesce(*chain, F.lit(""))


def is_premium(brand, name, brands) -> Column:
    """A profile brand somewhere in brand or name."""
    text = fold(F.concat_ws(" ", blank(brand), blank(name)), ae=False)
    return text.rlike(any_of([quoted(fold_py(b)) for b in brands]))
