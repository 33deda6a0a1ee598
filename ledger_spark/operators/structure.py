"""What a document's rows look like: its header, column roles, period, template and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark import rules
from ledger_spark.functions.cells import bound, nonempty, settled, stripped
from ledger_spark.operators.quality import document_text
from ledger_spark.operators.rule_sets import held, short
from ledger_spark.sources.scratch import stored

# Repairs of headers.
REPAIRS = [("tran saction", "transaction"), ("trans action", "transaction"), ("desc ription", "description"), ("de script ion", "description"), ("amt", "amount")]
PATTERN_REPAIRS = [(r"\bsaction\s+detail\b", "transaction detail"), (r"\bription\b", "description"), (r"amount\s*\(?\$?\)?", "amount"), (r"balance\s*\(?\$?\)?", "balance")]
#: what every cell holds that a repair changes
BROKEN = "|".join(broken for broken, _ in REPAIRS) + r"|\bsaction\s|\bription\b|(?:amount|balance)[\s($)]"


def header_cells(cells: Column) -> Column:
    """Header cells in lower case, with words that extraction broke put together and "date desc..." spread over two."""

    def repaired(cell: Column) -> Column:
        def fixed(out: Column) -> Column:
            for broken, whole in REPAIRS:
                out = F.replace(out, F.lit(broken), F.lit(whole))
            for pattern, whole in PATTERN_REPAIRS:
                out = F.regexp_replace(out, pattern, whole)
            return out

        return bound(F.lower(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))), lambda s: F.when(s.rlike(BROKEN), fixed(s)).otherwise(s))

    def spread(all_: Column) -> Column:
        at = lambda i: F.coalesce(F.get(all_, i), F.lit(""))
        pair = lambda i: F.trim(F.concat(at(i), F.lit(" "), at(i + 1)))
        kind = lambda p: F.when(p.rlike(r"\bdate\s+desc(?:ription)?\b"), 1).when(p.rlike("date tran|transaction detail"), 2).otherwise(0)
        kinds = F.transform(all_, lambda x, i: bound(pair(i), kind))

        def own(k: Column) -> Column:
            described, detailed = (lambda i: F.get(k, i) == 1), (lambda i: F.get(k, i) == 2)
            return F.transform(all_, lambda x, i: F.when(described(i) | (detailed(i) & F.contains(x, F.lit("date"))), "date").when(described(i - 1), "description").when(detailed(i - 1), "transaction detail").otherwise(x))

        return bound(kinds, own)

    return bound(F.transform(cells, repaired), spread)


#: what a row in lower case holds if header_cells puts words together or spreads them
CHANGED = BROKEN.replace(" ", r"\s+") + r"|date\s+(?:desc|tran)|transaction\s+detail"


def header_words(cells: Column) -> Column:
    """The different header words of header_cells; most rows hold nothing that it changes and are read as they are."""
    line = bound(F.lower(F.array_join(cells, " ", "")), lambda s: F.when(s.rlike(CHANGED), F.array_join(header_cells(cells), " ")).otherwise(s))
    return F.array_distinct(F.regexp_extract_all(line, F.lit(rf"\b(?:{'|'.join(rules.HEADER_WORDS)})\b"), F.lit(0)))


def header_score(cells: Column, least: int) -> Column:
    """Header words, with a bonus for a date beside a description and less for cells that are data; null if it is below
    least, which the words alone may tell."""

    def praise(words: Column) -> Column:
        beside = F.arrays_overlap(words, F.array(*map(F.lit, ("description", "activity", "particulars"))))
        return F.size(words) + F.when(F.array_contains(words, "date") & beside, 3).otherwise(0)

    def blame(bare: Column) -> Column:
        return bound(F.array_position(F.transform(bare, lambda c: c.rlike(rules.DATE_LIKE) & (F.length(c) < 12)), F.lit(True)), lambda first: data(bare, first))

    def data(bare: Column, first: Column) -> Column:
        amounts = F.size(F.filter(bare, lambda c, i: c.rlike(rules.AMOUNT_LIKE) & ((first == 0) | (i < first - 1))))
        return amounts + F.when(first > 0, 2).otherwise(0)

    less = bound(F.transform(cells, lambda c: stripped(F.coalesce(c, F.lit("")))), blame)
    score = bound(bound(header_words(cells), praise), lambda p: F.when(p >= least, p - less))
    return bound(score, lambda s: F.when(s >= least, s))


#: what header words and their repairs begin with: each word in a header stems from at least one of these in its row, at the
#: edge of a word (a Kelvin sign is a k in lower case)
STEMS = r"\b(?:d(?:ate|e(?:sc|bit|posit|tails))|ription|s(?:cript|action|ubtractions)|c(?:redit|hec[k\u212A])|balance|p(?:articulars|osted)|withdrawal|a(?:m(?:oun)?t|dditions|ctivity)|narration|tran|effective)"
#: or from pairs that are spread over two cells wherever they stand
PAIRS = r"date\s+tran|action\s+detail"


def scored_header(first: int, least: int) -> Column:
    """struct(score, at = -row_idx) of a row among the first ones that scores enough, else null. A score of 2 takes two
    words, so rows with fewer stems, which are most, aren't scored."""
    near = F.col("row_idx") < first
    if least >= 2:
        near &= F.array_join("cells", " ").rlike(rf"(?is){STEMS}.*?{STEMS}|{PAIRS}")
    found = lambda s: F.when(s.isNotNull(), F.struct(s.alias("score"), (-F.col("row_idx")).alias("at")))
    return F.when(near, bound(header_score(F.col("cells"), least), found))


def header_rows(rows: DataFrame, first: int = 80, least: int = 2) -> DataFrame:
    """doc_id, header_idx, score: the best of the first rows, the earliest of equals, if it scores enough."""
    scored = settled(rows.select("doc_id", scored_header(first, least).alias("s")), "s").filter("s IS NOT NULL")
    best = scored.groupBy("doc_id").agg(F.max("s").alias("b"))
    return best.select("doc_id", (-F.col("b.at")).alias("header_idx"), F.col("b.score").alias("score"))


def role_pattern(patterns: list[str]) -> str:
    """One pattern for all; what every one of them begins with, the edge of a word, is looked for once."""
    edge = r"\b"
    return rf"{edge}(?:{'|'.join(p.removeprefix(edge) for p in patterns)})" if all(p.startswith(edge) for p in patterns) else "|".join(patterns)


def column_roles(cells: Column) -> Column:
    """map role -> place: each header cell takes the first role in order that fits and is free."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))

    def step(state: Column, item: Column) -> Column:
        free = F.get(F.filter(item["fits"], lambda r: ~F.map_contains_key(state, r)), F.lit(0))
        return bound(free, lambda role: F.when(role.isNotNull(), F.map_concat(state, F.create_map(F.coalesce(role, F.lit("none")), item["i"]))).otherwise(state))

    fits = lambda c: F.array_compact(F.array(*(F.when(c.rlike(role_pattern(p)), F.lit(r)) for r, p in rules.ROLES.items())))  # noqa: E731  # a cell's roles, taken or not
    items = F.transform(header_cells(cells), lambda c, i: F.struct(F.when(c != "", fits(c)).alias("fits"), i.alias("i")))
    return F.aggregate(items, none, step)


FULL_DAY, MONTH_YEAR, YEAR_MONTH = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})", r"\b(0?[1-9]|1[0-2])[/-](20\d{2})\b", r"\b(20\d{2})[/-](0?[1-9]|1[0-2])\b"


def names_period(first: int) -> Column:
    """Whether a row among the first ones holds a date, MM-YYYY or YYYY-MM. None of them has a blank, so that one that the
    row's text holds stands in a cell."""
    return (F.col("row_idx") < first) & F.array_join("cells", " ", "").rlike(f"{FULL_DAY}|{MONTH_YEAR}|{YEAR_MONTH}")


def named_period() -> Column:
    """struct(year, month) that a row names, or null."""

    def found(text: Column, dates: bool) -> Column:
        group = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
        year = bound(group(FULL_DAY, 3), lambda y: F.when(y > 99, y).when(y < 70, y + 2000).otherwise(y + 1900))
        month = bound(group(FULL_DAY, 1), lambda m: F.when(m <= 12, m).otherwise(group(FULL_DAY, 2)))
        by_date = F.struct(year.alias("year"), month.alias("month"))
        tests = [(FULL_DAY, by_date)] if dates else []
        tests += [(MONTH_YEAR, F.struct(group(MONTH_YEAR, 2).alias("year"), group(MONTH_YEAR, 1).alias("month"))), (YEAR_MONTH, F.struct(group(YEAR_MONTH, 1).alias("year"), group(YEAR_MONTH, 2).alias("month")))]
        out = F.lit(None).cast("struct<year:int,month:int>")
        for pattern, value in reversed(tests):
            out = F.when(text.rlike(pattern), value).otherwise(out)
        return out

    cells = F.filter(F.transform("cells", lambda c: found(stripped(F.coalesce(c, F.lit(""))), True)), lambda f: f.isNotNull())
    return F.coalesce(F.get(cells, F.lit(0)), found(F.array_join("cells", " ", ""), False))


def period(rows: DataFrame, first: int = 40) -> DataFrame:
    """doc_id, year, month of the first full date, MM-YYYY or YYYY-MM in the first rows; cells come before row text."""
    own = Window.partitionBy("doc_id")
    each = rows.filter(names_period(first)).withColumn("_at", F.min("row_idx").over(own)).filter("row_idx = _at")
    return each.select("doc_id", named_period().alias("f")).filter("f IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "f.year", "f.month")


def with_balance_place(data: DataFrame) -> DataFrame:
    """Rows after the header (with header_idx and roles), and balance_idx: the column mapped as balance, else the one after
    the last mapped column if at least half of the first 30 rows have it."""
    own, last = Window.partitionBy("doc_id"), F.coalesce(F.array_max(F.map_values("roles")), F.lit(-1))
    nth = data.filter(F.col("row_idx") > F.col("header_idx")).withColumn("_n", F.row_number().over(own.orderBy("row_idx")))
    wide = F.avg(F.when(F.col("_n") <= 30, (F.size("cells") > last + 1).cast("double"))).over(own)
    place = F.coalesce(F.try_element_at("roles", F.lit("balance")), F.when(F.col("_wide") >= 0.5, last + 1))
    return nth.withColumn("_wide", wide).withColumn("balance_idx", place)


def balance_place(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """doc_id, balance_idx of with_balance_place, a row for each document with rows after its header."""
    data = rows.join(layout.select("doc_id", "header_idx", "roles").hint("merge"), "doc_id")
    return with_balance_place(data).filter("_n = 1").select("doc_id", "balance_idx")


def template_hits(texts: DataFrame, names: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, t, bank, head, sample: how many bank patterns and header words of a template (its number t) a text in lower
    case holds, and whether the document has the name of a sample (names has doc_id, file_name). Templates of which
    nothing is found have no row."""
    each = lambda column: templates.select("t", F.explode(column).alias("needle"))
    words = each("bank_patterns").withColumn("bank", F.lit(1)).unionByName(each("header_keywords").withColumn("bank", F.lit(0)))
    words = words.groupBy("t", F.lower("needle").alias("needle")).agg(F.sum("bank").alias("bank"), F.sum(1 - F.col("bank")).alias("head"))
    hits = short(held(texts, words.select("needle")), words, "needle").select("doc_id", "t", "bank", "head", F.lit(0).alias("sample"))
    own = texts.select("doc_id").join(names.select("doc_id", F.lower(F.coalesce("file_name", F.lit(""))).alias("needle")).hint("merge"), "doc_id")
    samples = short(own, each("sample_files").select("t", F.lower("needle").alias("needle")).distinct(), "needle")
    hits = hits.unionByName(samples.select("doc_id", "t", F.lit(0).alias("bank"), F.lit(0).alias("head"), F.lit(1).alias("sample")))
    return hits.groupBy("doc_id", "t").agg(F.sum("bank").alias("bank"), F.sum("head").alias("head"), F.max("sample").alias("sample"))


def _best(scored: DataFrame, least: int) -> DataFrame:
    best = scored.filter(F.col("score") >= least).groupBy("doc_id").agg(F.max_by(F.struct("template_id", "parser_format", "score", "bank_evidence"), F.struct("score", (-F.col("ord")).alias("o"))).alias("t"))
    return best.select("doc_id", "t.*")


def _free(hits: DataFrame, templates: DataFrame, least: int) -> DataFrame:
    """The best template by 4 a bank pattern, 1 a header word and 6 a sample's name."""
    scored = short(hits, templates.select("t", "template_id", "parser_format", "ord"), "t")
    return _best(scored.withColumn("bank_evidence", F.col("bank") > 0).withColumn("score", F.col("bank") * 4 + F.col("head") + F.col("sample") * 6), least)


def _prepared(rows: DataFrame, names: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    templates = stored(templates.withColumn("t", F.monotonically_increasing_id()))
    texts = stored(document_text(rows, 80, lower=True))
    return texts, templates, template_hits(texts, names, templates)


def select_template(rows: DataFrame, names: DataFrame, templates: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, template_id, parser_format, score, bank_evidence: the best template, the earliest of equals."""
    _, templates, hits = _prepared(rows, names, templates)
    return _free(hits, templates, least)


def template_for_key(rows: DataFrame, names: DataFrame, chosen: DataFrame, templates: DataFrame, keys: DataFrame) -> DataFrame:
    """chosen(doc_id, bank_key) narrows the templates; a single candidate is taken as it is, an unknown key falls back to
    select_template with a warning."""
    chosen = stored(chosen)
    texts, templates, hits = _prepared(rows, names, templates)
    hits = stored(hits)
    narrowed = templates.select("t", "template_id", "parser_format").join(keys, "template_id")
    asked = short(texts.select("doc_id").join(chosen.hint("merge"), "doc_id"), narrowed, "bank_key")
    scored = asked.join(hits.hint("merge"), ["doc_id", "t"], "left").na.fill(0, ["bank", "head", "sample"])
    direct = _best(scored.withColumn("bank_evidence", F.col("bank") > 0).withColumn("score", F.col("head") + F.col("sample") * 6), 0)
    free = _free(hits, templates, 3).select("doc_id", *(F.col(c).alias(f"f_{c}") for c in ("template_id", "parser_format")))
    out = chosen.join(direct.hint("merge"), "doc_id", "left").join(free.hint("merge"), "doc_id", "left")
    known = F.col("template_id").isNotNull()
    return out.select("doc_id", F.coalesce("template_id", "f_template_id").alias("template_id"), F.coalesce("parser_format", "f_parser_format").alias("parser_format"), F.when(~known, F.concat(F.lit("no template for key "), "bank_key")).alias("warning"))


def format_of(roles: Column) -> Column:
    has = lambda r: F.map_contains_key(roles, F.lit(r))
    return F.when(has("check_number") | has("tran_code"), "multicolumn").when(has("amount") & ~has("debit") & ~has("credit"), "signed_amount").otherwise("standard")


def sniffed(rows: DataFrame, block_marks: str = r"^$", section_marks: str = r"^$") -> DataFrame:
    """doc_id, repeated_blocks, sectioned from the first 120 rows: two headers of blocks, both section titles, or a mark
    of the caller's."""
    texts = document_text(rows, 120, lower=True)
    text = F.col("text")
    header = F.regexp_count(text, F.lit(r"\bdate\b.{0,30}\bdescription\b.{0,30}\bamount\b"))
    both = F.contains(text, F.lit("deposits and other credits")) & F.contains(text, F.lit("withdrawals and other debits"))
    return texts.select("doc_id", ((header >= 2) | text.rlike(block_marks)).alias("repeated_blocks"), (both | text.rlike(section_marks)).alias("sectioned"))


def with_header(rows: DataFrame) -> DataFrame:
    """rows with header_idx (0 if none was found) and header_found of their document."""
    best = F.max(scored_header(80, 2)).over(Window.partitionBy("doc_id"))
    return rows.withColumn("_b", best).withColumn("header_idx", F.coalesce(-F.col("_b.at"), F.lit(0))).withColumn("header_found", F.col("_b").isNotNull()).drop("_b")


def layouts(rows: DataFrame) -> DataFrame:
    """One row per document: header_idx (0 if none was found), header_found, roles, format."""
    own = Window.partitionBy("doc_id")
    is_head = F.col("row_idx") == F.col("header_idx")
    each = with_header(rows.select("doc_id", "row_idx", "cells")).withColumn("_from", F.min("row_idx").over(own)).withColumn("_any", F.max(is_head).over(own))
    one = each.filter(is_head | (~F.col("_any") & (F.col("row_idx") == F.col("_from"))))
    roles = column_roles(F.coalesce(F.when(is_head, F.col("cells")), F.array().cast("array<string>")))
    return one.select("doc_id", "header_idx", "header_found", roles.alias("roles")).withColumn("format", format_of(F.col("roles")))


def merge_wrapped(typed: DataFrame) -> DataFrame:
    """Rows of typed(doc_id, row_idx, cells, typed, date_col) where undated rows are joined to the dated row before them:
    their description cell, or all their text, is appended to its description. Undated rows before the first dated one
    are dropped."""
    w = Window.partitionBy("doc_id").orderBy("row_idx")
    dated = F.get("typed", F.col("date_col"))["date"].isNotNull()
    desc = F.col("date_col") + 1
    own = stripped(F.coalesce(F.get("cells", desc), F.lit("")))
    every = F.array_join(F.filter(F.transform("cells", lambda c: stripped(F.coalesce(c, F.lit("")))), lambda c: c != ""), " ")
    each = typed.withColumn("dated", dated).withColumn("island", F.sum(F.when(F.col("dated"), 1).otherwise(0)).over(w)).filter("island > 0").withColumn("more", F.when(~F.col("dated"), F.coalesce(nonempty(own), nonempty(every))))
    tail = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("more").isNotNull(), F.struct("row_idx", "more")))), lambda m: m["more"]), " ")
    base = [F.max(F.when(F.col("dated"), F.col(c))).alias(c) if c == "row_idx" else F.max_by(c, F.when(F.col("dated"), 1)).alias(c) for c in typed.columns if c != "doc_id"]
    out = each.groupBy("doc_id", "island").agg(*base, tail.alias("tail")).drop("island")
    place = F.col("date_col") + 1
    joined = F.transform("cells", lambda c, i: F.when((i == place) & (F.col("tail") != ""), F.concat(F.rtrim(F.coalesce(c, F.lit(""))), F.lit(" "), F.col("tail"))).otherwise(c))
    return out.withColumn("cells", joined).drop("tail")
