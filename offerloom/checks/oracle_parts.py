"""SQL building blocks the oracles share. They restate the rules in plain SQL over the
same views; word lists come from the fixed values."""
from .. import fixed_values as fv
from .views import POLICIES_SQL, RATES_SQL, RAW_SQL, TABLES, quote


def plain(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def words(parts):
    return quote(r"\b(?:" + "|".join(parts) + r")\b")


def inside(parts):
    return quote("(?:" + "|".join(parts) + ")")


def fold(x):
    return f"replace(replace(strip_accents(replace(lower({x}), '’', '''')), 'ø', 'o'), 'æ', 'ae')"


def fold_word(b):
    import unicodedata
    low = "".join(x for x in unicodedata.normalize("NFD", b.lower()) if not unicodedata.combining(x))
    return low.replace("ø", "o").replace("æ", "ae")


def eligible(name, desc):
    return (f"(regexp_matches({name}, {words(fv.TROUSER_WORDS)}, 'i') AND NOT regexp_matches({name}, {words(fv.EXCLUDED_WORDS)}, 'i') "
            f"AND NOT regexp_matches(strip_accents({name}), {words(fv.EXCLUDED_WORDS)}, 'i') "
            f"AND NOT regexp_matches({name}, {inside(fv.EXCLUDED_COMPOUNDS)}, 'i') "
            f"AND NOT regexp_matches(coalesce({desc}, ''), {words(fv.OTHER_WEARER_WORDS)}, 'i') "
            f"AND NOT regexp_matches(coalesce({desc}, ''), {inside(fv.OTHER_SPORT_COMPOUNDS)}, 'i'))")


BRAND = ("CASE " + " ".join(f"WHEN trim({fold('coalesce(brand, chr(32))')}) = {quote(fold_word(b))} THEN {quote(b)}" for b in fv.BRANDS)
         + " " + " ".join(
             f"WHEN regexp_matches({fold('coalesce(name, chr(32))')}, {quote('(?:^|[^a-z0-9])' + fold_word(b) + '(?:$|[^a-z0-9])')}) THEN {quote(b)}"
             for b in fv.BRANDS) + " ELSE '' END")

# Only the label shapes that occur in the view.
SIZE_CLASS = """CASE
  WHEN x = 'L' THEN 'target' WHEN x IN ('M', 'XL') THEN 'incompatible'
  WHEN x = 'W34 L32' THEN 'target' WHEN x = 'W36 L32' THEN 'incompatible'
  WHEN x = 'EU 50' THEN 'near' WHEN x = 'One Size' THEN 'unknown'
  WHEN length(x) = 3 AND x LIKE 'W%' THEN CASE WHEN x IN ('W33', 'W34') THEN 'near' ELSE 'incompatible' END
  WHEN length(x) <> 2 OR x LIKE 'W%' THEN 'unknown'
  WHEN x IN ('33', '34') THEN 'near'
  WHEN merchant_country = 'FR' THEN CASE WHEN x IN ('44', '46') THEN 'near'
    WHEN CAST(x AS INT) BETWEEN 34 AND 58 THEN 'incompatible' ELSE 'unknown' END
  WHEN x IN ('50', '52') THEN 'near'
  WHEN CAST(x AS INT) BETWEEN 42 AND 64 AND CAST(x AS INT) % 2 = 0 THEN 'incompatible'
  WHEN CAST(x AS INT) BETWEEN 24 AND 40 AND x NOT IN ('25', '26') THEN 'incompatible'
  ELSE 'unknown' END"""

EVIDENCE = """CASE WHEN len(sc) = 0 THEN 'unconfirmed' WHEN list_contains(sc, 'target') THEN 'confirmed'
  WHEN list_contains(sc, 'near') THEN 'probable'
  WHEN len(list_filter(sc, lambda c: c <> 'incompatible')) = 0 THEN 'no' ELSE 'unconfirmed' END"""

FIT = ("CASE WHEN NOT eligible OR regexp_matches(lower(name || ' ' || description), " + inside(fv.FIT_HEAVY_WORDS) + ") OR "
       "regexp_matches(lower(name), " + inside(fv.EXCLUDED_PRODUCT_TERMS) + ") THEN 0 ELSE greatest(0, least(100, 55 + 5 * ("
       + " + ".join(f"CAST(contains(lower(name || ' ' || description), {quote(w)}) AS INT)" for w in fv.FIT_PLUS_WORDS) + ") - 10 * ("
       + " + ".join(f"CAST(contains(lower(name || ' ' || description), {quote(w)}) AS INT)" for w in fv.FIT_MINUS_WORDS) + "))) END")

TIER = """CASE WHEN {d} >= 55 AND {f} >= 70 THEN 'Top Deal' WHEN {d} >= 45 THEN 'Strong Deal'
  WHEN {d} >= 40 THEN 'Good Deal' ELSE 'Near Miss' END"""

RAW_CTE = f"raw0 AS ({plain(RAW_SQL)}), raw AS (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM raw0)"
RATES_CTE = f"fx AS ({plain(RATES_SQL)})"
POLICY_CTE = f"policy AS ({plain(POLICIES_SQL)})"


def screen_ctes(source="raw", rate="(SELECT arg_max(rate, rate_date) FROM fx WHERE currency = r.currency)"):
    """P1 in steps: named columns, early reason, size, conversion, money, score."""
    return f"""
s1 AS (SELECT * REPLACE (trim(regexp_replace(name, '^\\s*(?:bis\\s+(?:zu\\s+)?)?[-–]?\\s*\\d{{1,2}}\\s*%\\s+', '', 'i')) AS name) FROM {source}),
s2 AS (SELECT *, {BRAND} AS known_brand, coalesce({eligible('name', 'description')}, false) AS eligible,
    coalesce(rrp > price AND rrp_source IS NOT NULL, false) AS rrp_verified,
    coalesce(discount_source IS NOT NULL AND observed_discount_pct >= 40, false) AS discount_verified,
    list_transform(sizes, lambda x: {SIZE_CLASS}) AS sc FROM s1),
s3 AS (SELECT *, eligible AND (rrp_verified OR discount_verified) AS price_evidence,
    CASE WHEN name IS NULL OR name = '' THEN 'name-missing' WHEN known_brand = '' THEN 'brand-not-allowed'
      WHEN currency IS NULL THEN 'currency-missing' WHEN price <= 0 THEN 'price-missing'
      WHEN NOT rrp_verified AND NOT discount_verified THEN 'discount-unverified'
      WHEN NOT eligible THEN 'product-mismatch' WHEN availability = 'Ausverkauft' THEN 'sold-out'
      WHEN color IN ('White', 'Neon Green') THEN 'excluded-color'
      WHEN {EVIDENCE} = 'no' THEN 'incompatible-size' END AS early,
    CASE WHEN {EVIDENCE} = 'confirmed' AND size_availability <> 'available' THEN 'unconfirmed' ELSE {EVIDENCE} END AS size1
  FROM s2),
s4 AS (SELECT r.* EXCLUDE (rrp, brand), CASE WHEN r.rrp_verified THEN r.rrp END AS rrp,
    CASE WHEN r.known_brand <> '' THEN r.known_brand ELSE r.brand END AS brand,
    CASE WHEN r.currency = 'EUR' THEN 1.0::DOUBLE ELSE {rate} END AS er FROM s3 r),
s5 AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN er IS NULL THEN 'conversion-error' END AS reason FROM s4),
s6 AS (SELECT *, CASE WHEN reason IS NULL THEN size1 END AS size_fit,
    CASE WHEN reason IS NULL THEN least(100, {FIT} + CASE WHEN color IN ('Blue', 'Black', 'Navy', 'Grey') THEN 5 ELSE 0 END) END AS product_fit_score,
    CASE WHEN reason IS NULL THEN price * er END AS price_eur, shipping IS NOT NULL AS shipping_known,
    CASE WHEN reason IS NULL THEN coalesce(shipping * er, 0) END AS shipping_eur,
    CASE WHEN reason IS NULL THEN return_cost * er END AS return_cost_eur,
    CASE WHEN reason IS NULL THEN rrp * er END AS rrp_eur FROM s5),
s7 AS (SELECT *, price_eur + shipping_eur + coalesce(return_cost_eur, 0) AS effective_cost_eur FROM s6),
s8 AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN rrp_eur IS NOT NULL THEN (1 - effective_cost_eur / rrp_eur) * 100
      ELSE (1 - (effective_cost_eur / price_eur) * (1 - observed_discount_pct / 100)) * 100 END END AS effective_discount_pct,
    CASE WHEN reason IS NULL THEN CASE WHEN rrp_eur IS NOT NULL THEN (1 - price_eur / rrp_eur) * 100 ELSE observed_discount_pct END END AS nominal_discount_pct
  FROM s7),
screened AS (SELECT *, CASE WHEN reason IS NULL THEN CAST(floor((CASE size_fit WHEN 'confirmed' THEN 100 WHEN 'probable' THEN 75 WHEN 'unconfirmed' THEN 45 ELSE 0 END * 0.30::DOUBLE
      + product_fit_score * 0.25::DOUBLE + 0 * 0.20::DOUBLE + greatest(0, least(100, effective_discount_pct * 1.5)) * 0.15::DOUBLE
      + CASE WHEN return_cost_eur IS NULL THEN 70 WHEN return_cost_eur = 0 THEN 85 ELSE 60 END * 0.10::DOUBLE) / 0.8::DOUBLE + 0.5) AS BIGINT) END AS score,
    CASE WHEN reason IS NULL THEN {TIER.format(d='effective_discount_pct', f='product_fit_score')} END AS class FROM s8),
offers AS (SELECT * FROM screened WHERE reason IS NULL)"""


KEY_COLUMNS = r"""
  CASE WHEN regexp_matches(url, '^https://') THEN source_id || '|' || lower(regexp_extract(url, '^https://([^/]+)', 1)) ||
      CASE WHEN rtrim(regexp_extract(url, '^https://[^/]+(/[^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^https://[^/]+(/[^?#]*)', 1), '/') END ||
      CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END
    ELSE lower(source_id || '|' || coalesce(brand, '') || '|' || coalesce(name, '') || '|' || coalesce(color, '')) END AS offer_key"""


def key_ctes(source="offers", out="keyed"):
    """F20-F22 over a relation."""
    return f"""
{out}_q AS (SELECT *, list_filter(string_split(regexp_extract(replace(url, '&amp;', '&'), '\\?([^#]*)', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '^(utm_.*|gclid|ref|aid)$')) AS q,
    trim(regexp_replace(lower(coalesce(brand, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS kb,
    trim(split_part(coalesce(name, ''), '|', 1)) AS kt FROM {source}),
{out}_k AS (SELECT *, {KEY_COLUMNS},
    trim(regexp_replace(lower(regexp_replace(CASE WHEN color IS NOT NULL AND ends_with(lower(kt), lower(' - ' || color))
      THEN left(kt, length(kt) - length(' - ' || color)) ELSE kt END, '^\\s*(?:herren|men''?s?)\\s+', '', 'i')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t1 FROM {out}_q),
{out}_m AS (SELECT *, CASE WHEN kb <> '' AND starts_with(t1, kb || ' ') THEN substr(t1, length(kb) + 2) ELSE t1 END AS t2 FROM {out}_k),
{out} AS (SELECT * EXCLUDE (q, kb, kt, t1, t2),
    CASE WHEN contains(t2, ' ') AND NOT regexp_matches(t2, {quote(fv.GENERIC_TITLE_PATTERN)}) THEN 'model|' || kb || '|' || t2 ELSE 'url|' || offer_key END AS model_key,
    CASE WHEN contains(t2, ' ') AND NOT regexp_matches(t2, {quote(fv.GENERIC_TITLE_PATTERN)}) THEN 'model|' || kb || '|' ||
      array_to_string(list_filter(string_split(t2, ' '), lambda w: NOT regexp_matches(w, {quote(fv.HIDE_GENERIC_WORD_PATTERN)})), ' ')
      ELSE 'url|' || offer_key END AS hide_key FROM {out}_m)"""


def best_ctes(source="keyed", best="best"):
    """W1 with row_number."""
    return f"""
{best} AS (SELECT * EXCLUDE (rn, class), CASE WHEN rrp_verified OR discount_verified THEN {TIER.format(d='effective_discount_pct', f='product_fit_score')} ELSE 'Near Miss' END AS class
  FROM (SELECT *, row_number() OVER (PARTITION BY offer_key ORDER BY
      (CAST(rrp_verified OR discount_verified AS INT) + CAST(shipping_known AS INT) + CAST(size_fit = 'confirmed' AS INT)) DESC,
      score DESC, effective_cost_eur, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
    min(seq) OVER (PARTITION BY offer_key) AS first_seq FROM {source} WHERE size_fit <> 'no') WHERE rn = 1)"""


QUALIFIES = """((rrp_verified OR discount_verified) AND class <> 'Near Miss' AND effective_discount_pct >= 40
  AND NOT (coalesce(ends_with(discount_source, '-upto'), false) AND NOT rrp_verified AND size_fit NOT IN ('confirmed', 'probable'))
  AND NOT effective_discount_pct > 85)"""


def model_ctes(best="best", out="models", scope=""):
    """W2 with row_number."""
    scope = scope + ", " if scope else ""
    return f"""
{out} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {scope}model_key ORDER BY CAST(qualifies AS INT) DESC, score DESC,
    effective_cost_eur, first_seq) AS rn, min(first_seq) OVER (PARTITION BY {scope}model_key) AS model_seq
  FROM (SELECT *, {QUALIFIES} AS qualifies FROM {best})) WHERE rn = 1)"""


SCREEN = f"WITH {RAW_CTE}, {RATES_CTE}, {screen_ctes()}"
KEYED = f"{SCREEN}, {key_ctes()}"
BEST = f"{KEYED}, {best_ctes()}"
MODELS = f"{BEST}, {model_ctes()}"
