"""Column -> Column functions: typing, keys, predicates. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docaudit import params as P

# Characters removed at both ends of a text value.
BLANKS = " \t\n\r\x0b\x0c 　"

# Fixed values of the 18-character company code: alphabet and weights.
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def has_text(c: Column) -> Column:
    """True when the text holds a character that is not blank (the same as a non-empty strip)."""
    return F.coalesce(c.rlike(f"[^{BLANKS}]"), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def contains_any(c: Column, words) -> Column:
    """True when the text holds one of the words; a missing text holds none."""
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return F.coalesce(hit, F.lit(False))


def safe_decimal(c: Column, precision: int = 38, scale: int = 2) -> Column:
    """Decimal of a text; anything that is not a plain number is null, never zero."""
    return strip(c.cast("string")).try_cast(f"decimal({precision},{scale})")


def safe_bool(c: Column) -> Column:
    word = F.lower(strip(c.cast("string")))
    return (
        F.when(word.isin("true", "1", "yes", "y", "t"), F.lit(True))
        .when(word.isin("false", "0", "no", "n", "f"), F.lit(False))
    )


def safe_json_object(c: Column) -> Column:
    """The JSON object inside a text as JSON text: unfenced, whole, or cut at the outer braces."""
    fenced = F.regexp_extract(c, r"(?i)```(?:json)?\s*([\s\S]*?)\s*```", 1)
    body = strip(F.when(fenced != "", fenced).otherwise(c))
    cut = F.regexp_extract(body, r"(\{[\s\S]*\})", 1)

    def valid(text: Column) -> Column:
        return F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), text)

    return F.coalesce(valid(body), valid(cut))



def identity_key(code: Column, number: Column) -> Column:
    """CODE#NUMBER, or null when one part is blank."""
    return F.concat(F.upper(blank_to_null(code)), F.lit("#"), F.upper(blank_to_null(number)))


def identity_of(code: Column, number: Column) -> Column:
    """CODE#NUMBER of parts known to hold text (see has_text); each part is evaluated once."""
    return F.upper(F.concat(strip(code), F.lit("#"), strip(number)))


def money_text(amount: Column, default: str = "0.00") -> Column:
    return F.coalesce(amount.cast("decimal(38,2)").cast("string"), F.lit(default))


def content_hash(code: Column, number: Column, amount: Column, issue_date: Column) -> Column:
    key = identity_key(code, number)
    day = F.coalesce(strip(issue_date), F.lit(""))
    return F.sha2(F.concat(key, F.lit("#"), money_text(amount), F.lit("#"), day), 256)


def fingerprint(code: Column, number: Column, amount: Column, issue_date: Column) -> Column:
    """Hash of key, amount and date; of the key alone without both; empty without a key."""
    key = identity_key(code, number)
    day = F.coalesce(issue_date, F.lit(""))
    bare = amount.isNull() & (day == "")
    full = F.concat(key, F.lit("#"), money_text(amount), F.lit("#"), strip(day))
    return F.coalesce(F.sha2(F.when(bare, key).otherwise(full), 256), F.lit(""))


def ingest_hash(code: Column, number: Column, amount: Column, issue_date: Column) -> Column:
    """Hash stored at ingest; null without a number or an amount."""
    raw = F.concat_ws(
        "#",
        F.coalesce(F.nullif(code, F.lit("")), F.lit("NONE")),
        number,
        amount.cast("decimal(38,2)").cast("string"),
        F.coalesce(F.nullif(issue_date, F.lit("")), F.lit("UNKNOWN")),
    )
    return F.when(F.nullif(number, F.lit("")).isNotNull() & amount.isNotNull(), F.sha2(raw, 256))


def trailing_number(c: Column) -> Column:
    """Digits at the end of the text, of any length, as text without leading zeros."""
    return F.nullif(F.regexp_replace(F.regexp_extract(strip(c), r"([0-9]+)$", 1), r"^0+(?=[0-9])", ""), F.lit(""))


LOW_DIGITS_MAX = 10**18 - 1


def trailing_parts(c: Column) -> tuple[Column, Column]:
    """The trailing number, of any length: ``low``, its last 18 digits as a number, and ``high``, the digits before
    them as text without leading zeros (empty for zero). Numbers order by length of high, high, low."""
    digits = F.regexp_extract(strip(c), r"([0-9]+)$", 1)
    return (
        F.when(digits != "", F.regexp_replace(F.left(digits, F.greatest(F.length(digits) - 18, F.lit(0))), "^0+", "")).alias("high"),
        F.when(digits != "", F.right(digits, F.lit(18)).cast("bigint")).alias("low"),
    )


def next_digits(digits: Column) -> Column:
    """A whole number in decimal text (empty: zero), plus one."""
    stem = F.regexp_replace(digits, "9+$", "")
    zeros = F.repeat(F.lit("0"), (F.length(digits) - F.length(stem)).cast("int"))
    raised = (F.right(stem, F.lit(1)).cast("int") + 1).cast("string")
    return F.when(stem == "", F.concat(F.lit("1"), zeros)).otherwise(
        F.concat(F.left(stem, F.greatest(F.length(stem) - 1, F.lit(0))), raised, zeros)
    )


def uscc_check_char(first17: Column) -> Column:
    total = F.lit(0)
    for i, weight in enumerate(USCC_WEIGHTS):
        total = total + (F.instr(F.lit(USCC_ALPHABET), F.substring(first17, i + 1, 1)) - 1) * weight
    return F.substring(F.lit(USCC_ALPHABET), (F.pmod(31 - total % 31, F.lit(31)) + 1), F.lit(1))


def uscc_valid(c: Column) -> Column:
    """True when the 18-character company code is well formed and its check character fits."""
    code = F.upper(strip(c))
    shape = code.rlike(r"^[0-9A-HJ-NPQRTUWXY]{18}$")
    fits = F.substring(code, 18, 1) == uscc_check_char(F.substring(code, 1, 17))
    return F.coalesce(shape & fits, F.lit(False))


def is_lodging_by_type(expense_type: Column) -> Column:
    return contains_any(expense_type, ("住宿",))


def is_lodging(expense_type: Column, item_desc: Column) -> Column:
    return contains_any(expense_type, ("住宿", "酒店")) | contains_any(item_desc, ("住宿", "酒店"))


def is_night_unit(unit: Column, item_desc: Column) -> Column:
    return F.coalesce(strip(unit).isin(*P.NIGHT_UNITS), F.lit(False)) | contains_any(
        unit, ("晚",)
    ) | contains_any(item_desc, ("间夜",))


def _whole_positive(c: Column) -> Column:
    n = safe_decimal(c, 24, 6).cast("bigint")
    return F.when(n > 0, n)


def night_count(stay_nights: Column, nights: Column, quantity: Column, unit: Column, item_desc: Column) -> Column:
    """Nights as a positive whole number; the quantity counts only when its unit means nights."""
    direct = _whole_positive(F.coalesce(stay_nights, nights))
    return F.coalesce(direct, F.when(is_night_unit(unit, item_desc), _whole_positive(quantity)))


def is_candidate_allowance(expense_type: Column, item_desc: Column) -> Column:
    return (
        F.coalesce(strip(expense_type).isin(*P.ALLOWANCE_TYPES), F.lit(False))
        | contains_any(expense_type, P.ALLOWANCE_WORDS)
        | contains_any(item_desc, P.ALLOWANCE_WORDS)
    )


def has_sensitive_word(item_desc: Column, expense_type: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(item_desc, F.lit("")), F.coalesce(expense_type, F.lit(""))))
    return contains_any(text, P.SENSITIVE_WORDS)


def is_abnormal_status(status: Column) -> Column:
    return contains_any(status, P.ABNORMAL_STATUS_WORDS)


# Document number prefix by type.
DOCUMENT_PREFIX = {
    "TRAVEL_REIMBURSEMENT": "TRV",
    "EXPENSE_REIMBURSEMENT": "EXP",
    "CORP_PAYMENT": "CORP",
    "ADVANCE_PAYMENT": "ADV",
    "BATCH_PAYMENT": "BAT",
}


def document_number(document_type: Column, day: Column, key: Column) -> Column:
    """PREFIX-yyyyMMdd-suffix; the suffix is 32 hex characters of a hash of the key, so reruns give the same number and
    two keys never share one."""
    prefix = F.lit("DOC")
    for name, short in DOCUMENT_PREFIX.items():
        prefix = F.when(document_type == name, F.lit(short)).otherwise(prefix)
    suffix = F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 32))
    return F.concat_ws("-", prefix, F.date_format(day, "yyyyMMdd"), suffix)


def cache_key(prefix: str, **fields: Column) -> Column:
    """Stable key of a verdict request: prefix and 24 characters of the hash of the sorted fields."""
    packed = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(packed, 256), 1, 24))


def fraction_box(value: Column, extent: Column) -> Column:
    """Pixel position on the 0-1000 grid, clamped; null where the page has no extent."""
    grid = F.try_divide(value.cast("double"), extent.cast("double")) * 1000
    return F.when(grid.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1000.0), grid)).cast("int"))
