"""Typing of text cells: amounts, dates and what rows of typed cells say, as Column expressions.

An expression that reads its input more than once binds it first (`bound`), so that a cascade of patterns runs each
pattern once per value and the generated code stays small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark import rules
from ledger_spark.sources.scratch import stored

Value = Column | str
DATE_FIRST = r"^(\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?)\b\s*"
ISO_FIRST = r"^(\d{4}-\d{1,2}-\d{1,2})\b\s*"
MONEY = r"[+-]?\(?\$?\s*\d[\d,]*\.\d{2}-?\)?"
MONEY_CELL = r"\(?\$?\s*\d[\d,]*\.\d{2}-?\)?|\(?\$?\s*\d{1,3}(?:,\d{3})+-?\)?"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# Forms that need no cascade of patterns, and marks of cells that no pattern fits: an amount of at most 11 digits, a full and
# a short date, a number that holds no date, letters and marks that no amount has (all but those that are taken out or read
# as digits).
PLAIN_AMOUNT = r"^-?\$?\d{1,3}(?:,?\d{3}){0,2}\.\d{2}\z"
PLAIN_DATE, BRIEF_DATE = r"^\d{2}/\d{2}/\d{4}\z", r"^\d{1,2}/\d{1,2}\z"
NO_DATE = r"^[-+]?\$?[\d,]*\d{3}\.\d{2}\z"
# What every date has, before letters are read as digits: a separator between digits or the name of a month.
MAY_DATE = rf"[\dOolI][/.-][\dOolI]|(?i:{'|'.join(MONTHS)})"
NO_AMOUNT = "[/A-Za-z&&[^OolIiSsBGgZzTRrNnDdCc]]"
# Letters that stand for digits between digits, separators or at an edge.
DIGIT_LETTERS = {"0": "Oo", "1": "lIi", "5": "Ss", "8": "B", "6": "Gg", "2": "Zz", "7": "T"}


def col(value: Value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: as what an aggregate over no element ends with. An array of one element would be
    copied, and taking it out again asks the whole expression for its type, for each row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def settled(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with these columns behind a generator of one row: a filter on them would otherwise be pushed below the
    expressions that make them and evaluate these again."""
    return rows.select(*(k for k in rows.columns if k not in columns), F.inline(F.array(F.struct(*columns))))


def stripped(value: Column) -> Column:
    return F.trim(value, F.lit(" \t\n\x0b\f\r"))


def nonempty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def plain_amount(s: Column) -> Column:
    return F.translate(s, ",$", "").try_cast("double")


def bare_amount(text: Column) -> Column:
    """amount of a text with a digit and without blanks around it."""

    def digits(s: Column) -> Column:
        fixed = s
        for digit, letters in DIGIT_LETTERS.items():
            fixed = F.regexp_replace(fixed, rf"(?<=^|[0-9., -])[{letters}](?=$|[0-9., -])", digit)
        return F.when(s.rlike(r"\d") & (F.length(s) <= 20) & s.rlike("[OolIiSsBGgZzT]"), fixed).otherwise(s)

    def number(s: Column, paren: Column) -> Column:
        bare = F.trim(F.regexp_replace(s, r"^[+-]+|[+-]+$", ""))
        european = bare.rlike(r"\d\.\d{3},\d{2}$") & ~bare.rlike(r"\d,\d{3}[,\d]")
        plain = F.when(european, F.translate(bare, ",.", ".")).otherwise(F.replace(bare, F.lit(","), F.lit("")))
        value = F.regexp_replace(plain, r"[^\d.]", "").try_cast("double")
        negative = paren | s.startswith("-") | s.endswith("-")
        ok = ~s.rlike("[A-Za-z/]") & (F.length(F.regexp_replace(s, "[^0-9]", "")) <= 12)
        return F.when(ok, F.when(negative, -value).otherwise(value))

    def parsed(s: Column) -> Column:
        paren = s.startswith("(") & s.endswith(")") & (F.length(s) > 1)
        inner = F.when(paren, F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)
        clean = F.regexp_replace(F.regexp_replace(inner, r"(?i)Rs\.?|INR|[$₹€£¥]", ""), r"(?i)\s*(?:Dr|Cr)\.?$", "")
        clean = F.regexp_replace(clean, r"^\s*[*#]*\s*|\s*[*#]*\s*$", "")
        return bound(clean, lambda c: F.when(~c.rlike(r"(?i)(?:x{2,}|\*{2,})\d{3,}"), bound(digits(c), lambda d: number(d, paren))))

    def quick(s: Column) -> Column:
        return F.when(s.rlike(PLAIN_AMOUNT), plain_amount(s)).when(~s.rlike(NO_AMOUNT), parsed(s))

    return quick(text)


def amount(raw: Value) -> Column:
    """The signed number in a cell, or null: parentheses and leading or trailing minus are negative; currency signs and
    Dr/Cr go; masked numbers, other letters, slashes and over 12 digits are no amounts; US and European separators."""
    raw = col(raw)
    return F.when(raw.rlike(r"\d"), bound(stripped(raw), bare_amount))


def make_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null. Days that any month has need no try."""
    zero = F.lit(0)

    def made(p: Column) -> Column:
        y, m, d = p["y"], p["m"], p["d"]
        tried = F.try_make_timestamp(y, m, d, zero, zero, F.lit(0.0)).cast("date")
        return F.when(m.between(1, 12), F.when(y.between(1, 9999) & d.between(1, 28), F.make_date(y, m, d)).when(d.between(1, 31), tried))

    return bound(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), made)


def _either(year: Column, a: Column, b: Column) -> Column:
    """Month first; day first where the other can't be."""
    return F.coalesce(make_date(year, a, b), make_date(year, b, a))


def _century(two: Column) -> Column:
    return F.when(two > 99, two).when(two < 70, two + 2000).otherwise(two + 1900)


def _month(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("int")
    return F.nullif(at, F.lit(0))


def plain_date(s: Column) -> Column:
    """The date of dd/dd/dddd, month first unless over 12; null for all other forms."""
    at = lambda i, n: F.substring(s, i, n).try_cast("int")
    return F.when(s.rlike(PLAIN_DATE), _either(at(7, 4), at(1, 2), at(4, 2)))


def date(raw: Value, year: Value, strict: bool = False) -> Column:
    """The date in a cell, or null. Patterns are tried in order, one that gives no valid date falls through: ISO,
    day/month/year (month first unless over 12), two-digit year (pivot 70), Mon dd[, yyyy], dd-Mon-yy, and m/d in `year`.
    strict leaves out short forms with a dot, which may be decimals."""
    raw = col(raw)
    return F.when(raw.rlike(r"\d"), bound(stripped(raw), lambda s: F.coalesce(plain_date(s), other_date(s, year, strict))))


def other_date(text: Column, year: Value, strict: bool = False) -> Column:
    """date of a text with a digit and without blanks around it, for which plain_date gives none."""
    year = col(year).cast("int")

    def part(pattern: str, s: Column, separator: str, use: Callable[[Column], Column]) -> Column:
        found = nonempty(F.regexp_extract(s, pattern, 0))
        return bound(F.split(found, separator), use)

    number = lambda parts, i: F.get(parts, F.lit(i)).try_cast("int")

    def parsed(s: Column) -> Column:
        iso = part(r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", s, "[-/]", lambda p: make_date(number(p, 0), number(p, 1), number(p, 2)))
        full = part(r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{4}\b", s, "[/.-]", lambda p: _either(number(p, 2), number(p, 0), number(p, 1)))
        short = part(r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2}\b", s, "[/.-]", lambda p: _either(_century(number(p, 2)), number(p, 0), number(p, 1)))
        named = r"\b([A-Za-z]{3})\.?\s+(\d{1,2})(?:[,\s]+(\d{4}))?\b"
        group = lambda i: F.regexp_extract(s, named, i)
        named_date = F.when(s.rlike(named), make_date(F.coalesce(nonempty(group(3)).try_cast("int"), year), _month(group(1)), group(2).try_cast("int")))
        dashed = part(r"\b\d{1,2}-[A-Za-z]{3}\.?-\d{2,4}\b", s, r"\.?-", lambda p: make_date(_century(number(p, 2)), _month(F.get(p, F.lit(1))), number(p, 0)))
        brief = part(r"\b\d{1,2}[/-]\d{1,2}\b" if strict else r"\b\d{1,2}[/.-]\d{1,2}\b", s, "[/.-]", lambda p: _either(year, number(p, 0), number(p, 1)))
        dashed = F.when(s.rlike(r"\d-[A-Za-z]"), dashed)
        digits = s.rlike(r"\d[/.-]\d")
        return F.coalesce(F.when(digits, F.coalesce(iso, full, short)), F.when(s.rlike("[A-Za-z]{3}"), F.coalesce(named_date, dashed)), F.when(digits, brief))

    def fixed(s: Column) -> Column:
        zeros = F.regexp_replace(s, r"(?<=\d)[Oo]|[Oo](?=\d)", "0")
        ones = F.regexp_replace(zeros, r"(?<=\d)[lI]|[lI](?=\d)", "1")
        return F.when(s.rlike(r"[/.-]") & (F.length(s) <= 15) & s.rlike("[OolI]"), ones).otherwise(s)

    def quick(s: Column) -> Column:
        short = bound(F.split(s, "/"), lambda p: _either(year, number(p, 0), number(p, 1)))
        return F.when(s.rlike(BRIEF_DATE), short).when(s.rlike(MAY_DATE) & ~s.rlike(NO_DATE), bound(fixed(s), parsed))

    return quick(text)


def stored_date(raw: Value) -> tuple[Column, Column]:
    """Lenient parse of a stored date, and whether none was found (the date is then null, never the clock's)."""
    raw = F.trim(col(raw))
    found = F.coalesce(F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")).cast("date"), date(raw, F.lit(None).cast("int")))
    return found, found.isNull()


def split_date(cell: Value, year: Value) -> tuple[Column, Column]:
    """The date that leads a cell and the rest of it; null and the whole cell if none does."""
    both = split_cell(cell, year)
    return both["lead"], both["rest"]


def split_cell(cell: Value, year: Value) -> Column:
    """struct(lead, rest) of what split_date returns, each date read once."""

    def split(cell: Column) -> Column:
        slash, iso = nonempty(F.regexp_extract(cell, DATE_FIRST, 1)), nonempty(F.regexp_extract(cell, ISO_FIRST, 1))
        dates = F.struct(date(slash, year).alias("slash"), date(iso, year).alias("iso"))

        def parts(d: Column) -> Column:
            rest = F.when(d["slash"].isNotNull(), F.regexp_replace(cell, DATE_FIRST, "")).when(d["iso"].isNotNull(), F.regexp_replace(cell, ISO_FIRST, ""))
            return F.struct(F.coalesce(d["slash"], d["iso"]).alias("lead"), F.coalesce(stripped(rest), cell).alias("rest"))

        none = F.struct(F.lit(None).cast("date").alias("lead"), cell.alias("rest"))
        return F.when(cell.rlike(r"^\d{1,4}[/-]\d"), bound(dates, parts)).otherwise(none)

    return bound(stripped(col(cell)), split)


def is_money(cell: Value) -> Column:
    return F.coalesce(col(cell).rlike(MONEY_CELL), F.lit(False))


def money_values(cell: Value) -> Column:
    """All amounts with cents in a text, in order."""
    found = F.regexp_extract_all(F.coalesce(col(cell), F.lit("")), F.lit(f"({MONEY})"), F.lit(1))
    return F.filter(F.transform(found, amount), lambda v: v.isNotNull())


def decimal(raw: Value) -> Column:
    return F.replace(col(raw).cast("string"), F.lit(","), F.lit("")).try_cast("decimal(14,2)")


def description_of(cells: Value, year: Value) -> Column:
    """The cells that are neither dates nor amounts, joined."""
    kept = F.filter(F.transform(col(cells), stripped), lambda c: (c != "") & date(c, year).isNull() & amount(c).isNull())
    return F.array_join(kept, " ")


def type_cells(rows: DataFrame, year: Value) -> DataFrame:
    """rows with typed: array of (text, amount, date, lead, rest); lead and rest are a leading date and what follows it.
    Cells are typed where they lie: most have a plain form, and none is shuffled."""
    year = col(year).cast("int")

    def cell(s: Column, amount_: Column, date_: Column, lead: Column, rest: Column) -> Column:
        return F.struct(s.alias("text"), amount_.alias("amount"), date_.alias("date"), lead.alias("lead"), rest.alias("rest"))

    def typed(s: Column) -> Column:
        no_amount, no_date = F.lit(None).cast("double"), F.lit(None).cast("date")
        every = bound(split_cell(s, year), lambda d: cell(s, bare_amount(s), other_date(s, year), d["lead"], d["rest"]))
        dated = bound(plain_date(s), lambda d: F.when(d.isNotNull(), cell(s, no_amount, d, d, F.lit(""))).otherwise(every))
        plain = s.rlike(PLAIN_AMOUNT) & s.rlike(NO_DATE)
        undated = F.when(~s.rlike(r"\d"), cell(s, no_amount, no_date, no_date, s)).when(plain, cell(s, plain_amount(s), no_date, no_date, s))
        return undated.when(~s.rlike(MAY_DATE), cell(s, bare_amount(s), no_date, no_date, s)).otherwise(dated)

    each = F.transform(F.transform("cells", lambda c: stripped(F.coalesce(c, F.lit("")))), typed)
    empty = F.array().cast("array<struct<text:string,amount:double,date:date,lead:date,rest:string>>")
    return rows.withColumn("typed", F.coalesce(each, empty))


AMBIGUOUS = r"^([0-9]{1,2})[/.-]([0-9]{1,2})(?:[/.-][0-9]{2,4})?$"


def ambiguous(text: Column) -> Column:
    """Whether a numeric date means two different days, depending on which number is the month."""
    digits = F.translate(F.trim(text), "Oo", "00")
    a, b = (nonempty(F.regexp_extract(digits, AMBIGUOUS, k)).try_cast("int") for k in (1, 2))  # a cast that fails costs an exception
    return F.coalesce(a.between(1, 12) & b.between(1, 12) & (a != b), F.lit(False))


def coverage(typed: DataFrame, *keys: str) -> DataFrame:
    """Per column (and per further keys, such as doc_id): how many cells, which shares of them are empty, amounts and dates,
    and which share of the dates is ambiguous. One pass over the cells; sums are formed before they are shuffled."""
    each = settled(typed.select(*keys, "typed"), "typed").select(*keys, F.posexplode("typed").alias("column", "cell"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    dated = F.col("cell.date").isNotNull()
    return each.groupBy(*keys, "column").agg(
        F.count("*").alias("cells"), share(F.trim("cell.text") == "").alias("empty"), share(F.col("cell.amount").isNotNull()).alias("amounts"), share(dated).alias("dates"),
        F.coalesce(F.avg(F.when(dated, ambiguous(F.col("cell.text")).cast("double"))), F.lit(0.0)).alias("ambiguous"),
    )


def once(rows: DataFrame, columns: list[str], **values: Column) -> DataFrame:
    """rows with values that only depend on these columns, computed once for each different combination: worth it for long
    expressions over texts that repeat. The table of combinations is broadcast if a count shows that it is short."""
    known = stored(rows.select(*columns).distinct().select(*(F.col(c).alias(f"__{c}") for c in columns), *(v.alias(k) for k, v in values.items())))
    same = F.lit(True)
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(F.broadcast(known) if known.count() <= 500_000 else known.hint("merge"), same).drop(*(f"__{c}" for c in columns))



Sides = tuple[Column, Column]


def _side(condition: Column, value: Column) -> Sides:
    """(debit, credit): value is a debit where condition holds."""
    return F.when(condition, value), F.when(~condition, value)


def by_columns(debit: Column, credit: Column, text: Column) -> Sides:
    """From separate debit and credit amounts; a lone credit whose row speaks of debits only is a debit."""
    upper = F.upper(text)
    flip = debit.isNull() & credit.isNotNull() & upper.rlike(rules.TWO_COLUMN_DEBIT) & ~upper.rlike(rules.TWO_COLUMN_CREDIT)
    used = lambda v: F.when(v != 0, F.abs(v))
    return F.when(flip, F.abs(credit)).otherwise(used(debit)), F.when(~flip, used(credit))


def by_amount_column(value: Column, left: Column, is_balance: Column) -> Sides:
    """From one signed amount; the cell to its left if the amount column is the balance."""
    value = F.when(value.isNotNull() & is_balance & left.isNotNull(), left).otherwise(value)
    return F.when(value < 0, F.abs(value)), F.when(value >= 0, value)


def by_largest(values: Column, text: Column) -> Sides:
    """From the amount of largest size in the row (the first of equals) and the row's words."""
    best = F.array_max(F.transform(values, lambda v, i: F.struct(F.abs(v).alias("size"), (-i).alias("at"), v.alias("v"))))["v"]
    upper = F.upper(text)
    debit = (best < 0) | (upper.rlike(rules.ANY_AMOUNT_DEBIT) & ~upper.rlike(rules.ANY_AMOUNT_CREDIT))
    return _side(debit, F.abs(best))


def by_sign(value: Column, text: Column) -> Sides:
    """From a signed amount: negative is a debit, and so is a positive one in a row with debit words; zero is neither."""
    debit = (value < 0) | F.upper(text).rlike(rules.SIGNED_DEBIT)
    return _side(debit, F.when(value != 0, F.abs(value)))


def by_context(value: Column, text: Column, section: Column | None = None) -> Sides:
    """From the section that a row stands in, then its words; a credit if nothing tells."""
    upper = F.upper(text)
    section = F.lit(None).cast("string") if section is None else section
    words = upper.rlike(rules.CONTEXT_DEBIT) | F.regexp_replace(upper, r"\s+", "").rlike(rules.CONTEXT_DEBIT_COMPACT)
    debit = (value < 0) | F.when(section.isin("credit", "debit"), section == "debit").otherwise(words)
    return _side(debit, F.abs(value))
