"""Date rules: cleaning, repair and consistency. Results are ISO strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import digit_repair, first_case, first_of, let

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
FIRST_YEAR, LAST_YEAR = 1990, 2030


def month_of(name: Column) -> Column:
    """The month that the first three letters name."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("int"))


def full_month(name: Column) -> Column:
    """The month of a whole or abbreviated name, and of no other spelling."""
    low = F.lower(name)
    at = F.greatest(
        F.array_position(F.array(*map(F.lit, MONTHS)), low), F.array_position(F.array(*map(F.lit, NAMES)), low)
    )
    return F.when(at > 0, at.cast("int"))


def pivoted(year: Column, pivot: int = 50) -> Column:
    return F.when(year >= 100, year).when(year < pivot, year + 2000).otherwise(year + 1900)


def _iso(year: Column, month: Column, day: Column, clamp: bool) -> Column:
    ok = year.between(FIRST_YEAR, LAST_YEAR) & month.between(1, 12)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when(leap, 29).otherwise(28)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    shown = lambda d: F.concat(year.cast("string"), F.lit("-"), two(month), F.lit("-"), two(d))  # years have four digits
    if clamp:
        return F.when(ok, shown(F.least(day, last)))
    return F.when(ok & (day >= 1) & (day <= last), shown(day))


def iso(year: Column, month: Column, day: Column) -> Column:
    """The ISO date of whole numbers, null if there is none."""
    return _iso(year, month, day, False)


def _part(text: Column, pattern: str, group: int) -> Column:
    return first_of(text, pattern, group).try_cast("int")


def _matched(text: Column, pattern: str, groups: int) -> list[Column]:
    return [first_of(text, pattern, g) for g in range(1, groups + 1)]


_TEXT_MDY = r"^([A-Za-z]+)\s+([0-9]{1,2}),?\s*([0-9]{2,4})$"
_NUM_MDY = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})$"


_SEP = "\x01"


def _form(text: Column, pattern: str, order: tuple[str, str, str], clamp: bool, month=None, year=None) -> Column:
    """The ISO date of a text that a pattern matches as a whole; ``order`` names the groups of
    year, month and day. One match gives all three, and each is computed once."""
    number = lambda c: c.try_cast("int")
    month, year = month or number, year or number

    def of(p: Column) -> Column:
        parts = F.struct(year(p[0]).alias("y"), month(p[1]).alias("m"), number(p[2]).alias("d"))
        return F.when(F.size(p) == 3, let(parts, lambda x: _iso(x["y"], x["m"], x["d"], clamp)))

    return F.when(text.rlike(pattern), let(F.split(F.regexp_replace(text, pattern, _SEP.join(order)), _SEP), of))


def _pivoted(text: Column) -> Column:
    return let(text.try_cast("int"), lambda year: pivoted(year))  # of one parameter, as a second would be the place


def repaired(text: Column) -> Column:
    """Month-first dates with the day held to the month's last."""
    dashed = F.replace(text, F.lit("."), F.lit("-"))
    return F.coalesce(
        _form(text, _TEXT_MDY, ("$3", "$1", "$2"), True, month_of, _pivoted), _form(dashed, _NUM_MDY, ("$3", "$1", "$2"), True, None, _pivoted)
    )


def cleaned(value: Column) -> Column:
    """The date that a text writes: month-first where that is possible, repaired
    to the month's end, else day-first or year-first; null if it is none.

    One lambda holds the branches, so that they share the text and do not
    swell the code generated for the stage."""
    return F.element_at(F.transform(F.array(F.trim(value)), _cleaned), 1)


def _cleaned(text: Column) -> Column:
    return let(F.translate(text, "./", "--"), lambda dashed: _cleaned_of(text, dashed))


def _cleaned_of(text: Column, dashed: Column) -> Column:
    short = lambda y: let(y.try_cast("int"), lambda n: F.when(n < 69, n + 2000).otherwise(n + 1900))
    return F.when(
        ~text.rlike(r"^[0-9]{4}$"),
        F.coalesce(
            repaired(text),
            _form(text, r"^([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4})$", ("$3", "$2", "$1"), False, full_month),
            _form(dashed, r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", ("$1", "$2", "$3"), False),
            _form(dashed, r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", ("$3", "$2", "$1"), False),
            _form(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", ("$1", "$2", "$3"), False),
            _form(dashed, r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{2})$", ("$3", "$2", "$1"), False, None, short),
        ),
    )


def flexible(value: Column) -> Column:
    """A date in one of a spreadsheet's usual forms, as ISO; null otherwise."""
    return F.element_at(F.transform(F.array(F.trim(value)), _flexible), 1)  # one lambda, as above


def _flexible(text: Column) -> Column:
    numeric = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$"
    return F.coalesce(
        _form(text, r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", ("$1", "$2", "$3"), False),
        _form(text, numeric, ("$3", "$1", "$2"), False),
        _form(text, numeric, ("$3", "$2", "$1"), False),
        _form(text, r"^([A-Za-z]+)\s+([0-9]{1,2}),?\s+([0-9]{4})$", ("$3", "$1", "$2"), False, full_month),
    )


def terms_days(text: Column) -> Column:
    """Days of 'NET n DAYS' terms between 1 and 365."""
    n = _part(text, r"(?i)\bnet\s*([0-9]{1,3})(?:\s*days?)?\b", 1)
    return F.when(n.between(1, 365), n)


def consistency(invoice: Column, due: Column, as_of: Column) -> Column:
    """The first thing wrong with two ISO dates, null if nothing is."""
    i, d = F.try_to_timestamp(invoice, F.lit("yyyy-MM-dd")), F.try_to_timestamp(due, F.lit("yyyy-MM-dd"))
    return first_case(
        [
            (i > as_of, F.lit("future")),
            (F.datediff(as_of, i) / 365 > 5, F.lit("older_than_5_years")),
            (d < i, F.lit("due_before_invoice")),
            (F.datediff(d, i) > 180, F.lit("terms_over_180_days")),
        ],
        F.lit(None).cast("string"),
    )


def duration(ms: Column) -> Column:
    seconds = ms / 1000
    return (
        F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.floor(seconds % 60).cast("string"), F.lit("s")))
    )


# Written forms of a date near its label, in order of preference; the second lacks a year, the last a month.
MONTH_NAME = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)"
NEAR_LABEL = (MONTH_NAME + r"\s+\d{1,2},?\s*\d{2,4}", MONTH_NAME + r"\s+\d{1,2}", r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", r"\d{1,2}\s*,\s*\d{4}")
DAY_YEAR = r"\b(\d{1,2})\s*,\s*(\d{4})\b"
INVOICE_DATE_LABELS = ("invoice date", "date", "invoice")
DUE_DATE_LABELS = ("due date", "payment due", "payment terms")


def _windows(text: Column, labels: tuple[str, ...], size: int) -> Column:
    """What follows each label's first place, and at last the whole text."""
    low = F.lower(text)
    after = [F.when(low.contains(label), F.substr(text, F.instr(low, F.lit(label)), F.lit(size))) for label in labels]
    return F.array_compact(F.array(*after, text))


def _first(windows: Column, rule) -> Column:
    return F.try_element_at(F.filter(F.transform(windows, rule), lambda found: found.isNotNull()), F.lit(1))


def labelled(text: Column, labels: tuple[str, ...], year: Column | None = None) -> Column:
    """A date as the text writes it after one of the labels, else anywhere; ``year`` completes one without a year of four digits."""

    def of(window: Column) -> Column:
        found = [F.nullif(F.trim(F.regexp_extract(window, "(?i)" + p, 0)), F.lit("")) for p in NEAR_LABEL]
        whole = [F.when(f.rlike(r"\d{4}"), f) if year is None else F.when(f.rlike(r"\d{4}"), f).otherwise(F.concat(f, F.lit(" "), year.cast("string"))) for f in found]
        return F.coalesce(*whole)

    return _first(_windows(text, labels, 150), of)


def monthless(text: Column, labels: tuple[str, ...], year: Column | None = None) -> Column:
    """'28, 2008' completed by the month that its window names first, else the text."""
    anywhere = first_of(text, "(?i)" + MONTH_NAME)

    def of(window: Column) -> Column:
        month = F.coalesce(first_of(window, "(?i)" + MONTH_NAME), anywhere)
        own = first_of(window, DAY_YEAR, 2)
        return F.concat(month, F.lit(" "), first_of(window, DAY_YEAR), F.lit(", "), own if year is None else F.coalesce(year.cast("string"), own))

    return _first(_windows(text, labels, 200), of)


def recovered(text: Column, labels: tuple[str, ...], year: Column | None, hint: Column) -> Column:
    """The ISO date that a text holds for a field whose own value is unreadable; ``hint`` is the year of one without a month."""
    candidates = F.array(labelled(text, labels, year), monthless(text, labels, hint))  # the second needs what the first finds
    return _first(candidates, lambda c: _cleaned(F.trim(c)))


def simple(value: Column) -> Column:
    """Dates written with digits as ISO, month-first; other values as they are, trimmed."""
    text = F.trim(F.coalesce(value, F.lit("")))
    iso = F.regexp_extract(text, r"(\d{4})-(\d{2})-(\d{2})", 0)
    american = r"^.*?(\d{2})(?:/(\d{2})/|-(\d{2})-)(\d{4}).*$"
    return F.when(iso != "", iso).when(text.rlike(american), F.regexp_replace(text, american, "$4-$1-$2$3")).otherwise(text)


# Dates inside a line of recognised text.
MONTH_WORD = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
LINE_MDY = rf"(?i)\b{MONTH_WORD}\s+(\d{{1,2}})(?:st|nd|rd|th)?[,\s]+(\d{{2,4}})\b"
LINE_DMY = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{MONTH_WORD}[,\s]+(\d{{2,4}})\b"
LINE_NUMERIC = (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{1,2}\s+\d{1,2}[/-]\d{2,4}\b", r"\b\d{1,2}\s+\d{1,2}\s+\d{2,4}\b")


def month_date(text: Column) -> Column:
    """A date with a month's name, in either order, as MM/DD/YYYY."""
    written = lambda month, day, year: F.format_string("%02d/%02d/%04d", month_of(month), day.try_cast("int"), pivoted(year.try_cast("int")))
    m, d, y = _matched(text, LINE_MDY, 3)
    d2, m2, y2 = _matched(text, LINE_DMY, 3)
    return F.when(y.isNotNull(), written(m, d, y)).when(y2.isNotNull(), written(m2, d2, y2))


def _plausible(pairs: Column, month: str, day: str, order: tuple[str, ...]) -> Column:
    ok = F.filter(pairs, lambda p: p[month].cast("int").between(1, 12) & p[day].cast("int").between(1, 31))
    return F.try_element_at(F.transform(ok, lambda p: F.concat_ws("/", *[p[x] for x in order])), F.lit(1))


def in_line(text: Column) -> Column:
    """The date of a line: with a month's name, with digits and marks or blanks, or of
    any groups of digits that can be month, day and year."""
    as_written = [F.regexp_replace(first_of(text, p, 0), r"\s+", "/") for p in LINE_NUMERIC]
    digits = F.trim(F.regexp_replace(text, "[^0-9]+", "/"), F.lit("/"))
    groups = lambda p: F.arrays_zip(*[F.regexp_extract_all(digits, F.lit(p), F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "b"), (3, "c"))])
    collapsed = F.coalesce(
        _plausible(groups(r"(\d{1,2})/(\d{1,2})/(\d{2,4})"), "a", "b", ("a", "b", "c")),
        _plausible(groups(r"(\d{4})/(\d{1,2})/(\d{1,2})"), "b", "c", ("b", "c", "a")),
    )
    return F.coalesce(month_date(text), *as_written, collapsed)


def fused(value: Column) -> Column:
    """The date of recognised words: with a month's name, else the first three numbers with
    marks between them, letters read for digits mended; null if there are none."""
    mended = digit_repair(value)
    digits = F.trim(F.regexp_replace(mended, "[^0-9]+", "/"), F.lit("/"))
    year, month, day = _matched(digits, r"(\d{4})/(\d{1,2})/(\d{1,2})", 3)
    return F.coalesce(
        F.when(value.rlike("[A-Za-z]{3}"), month_date(value)),  # no month's name is shorter
        first_of(mended, r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})", 0),
        first_of(digits, r"(\d{1,2})/(\d{1,2})/(\d{2,4})", 0),
        F.when(year.isNotNull(), F.concat_ws("/", month, day, year)),
    )


def cropped(text: Column, as_of: Column) -> Column:
    """The first date with a year of four digits, from five years before to two after ``as_of``, as ISO; null if none."""
    named = F.regexp_extract_all(text, F.lit(r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},\s*\d{4})\b"), F.lit(1))
    iso = F.regexp_extract_all(text, F.lit(r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b"), F.lit(1))
    american = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b"), F.lit(1))
    tidy = lambda c: F.regexp_replace(F.replace(c, F.lit("/"), F.lit("-")), r",\s*", ", ")
    found = F.transform(F.concat(named, iso, american), lambda c: _flexible(F.regexp_replace(tidy(c), r"(?i)^sept ", "Sep ")))
    year = F.year(as_of)
    return F.try_element_at(F.filter(found, lambda d: F.substring(d, 1, 4).cast("int").between(year - 5, year + 2)), F.lit(1))


def date_token(token: Column) -> Column:
    """Whether a token may be part of a date."""
    return token.rlike(r"[0-9]") | token.rlike("(?i)" + "|".join(MONTHS))


def not_future(value: Column, as_of: Column) -> Column:
    return F.try_to_timestamp(value, F.lit("yyyy-MM-dd")) <= as_of
