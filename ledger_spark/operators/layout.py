"""Positioned text to rows of cells, and what kind of document the pages make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark import rules
from ledger_spark.functions.cells import settled, stripped
from ledger_spark.functions.text import clean_cell

PAGE = ["doc_id", "page_no"]


def word_cells(words: DataFrame) -> DataFrame:
    """Words with line (from 0 in each page), cell (from 0 in each line): words whose tops fall into one bin are a line,
    bins are half the (upper) median height of the page's words; a gap of 2 % of the page's width starts a cell."""
    page, height = Window.partitionBy(*PAGE), F.col("bottom") - F.col("top")
    ranked = words.withColumn("k", F.row_number().over(page.orderBy(height))).withColumn("n", F.sum(height.isNotNull().cast("int")).over(page)).withColumn("nulls", F.count("*").over(page) - F.col("n"))
    middle = F.col("k") - F.col("nulls") - 1 == F.floor(F.col("n") / 2)  # nulls are ranked first and don't count
    binned = ranked.withColumn("h", F.max(F.when(middle, height)).over(page)).drop("k", "n", "nulls").withColumn("bin", F.greatest(F.lit(4.0), F.col("h") * 0.5)).withColumn("y", F.rint(F.col("top") / F.col("bin")).cast("long"))
    line = Window.partitionBy(*PAGE, "y").orderBy("x0", "word_idx")
    gap = F.col("x0") - F.lag("x1").over(line) > F.greatest(F.lit(12.0), F.coalesce("page_width", F.lit(612.0)) * 0.02)
    celled = binned.withColumn("new", F.when(gap, 1).otherwise(0)).withColumn("cell", F.sum("new").over(line))
    return celled.withColumn("line", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("y")) - 1).drop("h", "bin", "new")


def words_to_rows(words: DataFrame) -> DataFrame:
    """rows(doc_id, row_idx, cells) in the order of pages and lines."""
    text = lambda items: F.array_join(F.transform(F.sort_array(items), lambda w: w["text"]), " ")
    cells = word_cells(words).groupBy(*PAGE, "y", "cell").agg(clean_cell(text(F.collect_list(F.struct("x0", "word_idx", "text")))).alias("text"))
    lines = cells.groupBy(*PAGE, "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]).alias("cells"))
    return numbered_rows(lines.filter(F.exists("cells", lambda c: c != "")), "page_no", "y")


def numbered_rows(lines: DataFrame, *order: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return lines.select("doc_id", nth.alias("row_idx"), "cells")


def layout_report(words: DataFrame, most_words: int | None = None, most_pages: int | None = None) -> DataFrame:
    """Boxes of rows (cell null) and cells with their numbers of words; on request only of the first pages of a document
    and the first words of a page."""
    if most_pages is not None:
        words = words.filter(F.col("page_no") <= most_pages)
    if most_words is not None:
        words = words.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("word_idx"))).filter(F.col("n") <= most_words).drop("n")
    box = [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]
    cells = word_cells(words).filter("doc_id IS NOT NULL").groupBy("doc_id", "page_no", "line", "cell").agg(*box, F.count("*").alias("n_words"))
    # the levels of a rollup, by a row of each cell for each, so that all stay in their document's partition
    each = cells.withColumn("level", F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 1, 3, 7)))))
    for name, most in (("cell", 0), ("line", 1), ("page_no", 3)):
        each = each.withColumn(name, F.when(F.col("level") <= most, F.col(name)))
    out = each.groupBy("doc_id", "page_no", "line", "cell", "level").agg(*box, F.sum("n_words").alias("n_words"))
    return out.select("doc_id", "page_no", "line", "cell", "x0", "top", "x1", "bottom", "n_words", "level")


def ocr_lines(pages: DataFrame) -> DataFrame:
    """Lines of parallel arrays of texts, scores and boxes (x0, y0, x1, y1): centre, height and bounds; without a box the
    centre is (0, 14 * place) and the height 12. Empty texts are left out."""
    place = F.posexplode(F.transform("texts", lambda t, i: F.struct(t.alias("text"), F.get("scores", i).alias("score"), F.get("boxes", i).alias("box"))))
    each = pages.select(*PAGE, place.alias("line_idx", "l")).select(*PAGE, "line_idx", F.trim("l.text").alias("text"), "l.score", "l.box").filter("text <> ''")
    at = lambda i: F.get("box", F.lit(i))
    boxed = F.size(F.coalesce("box", F.array().cast("array<double>"))) >= 4
    x, y = F.when(boxed, (at(0) + at(2)) / 2).otherwise(0.0), F.when(boxed, (at(1) + at(3)) / 2).otherwise(F.col("line_idx") * 14.0)
    h = F.when(boxed, F.greatest(F.lit(1.0), at(3) - at(1))).otherwise(12.0)
    bound = lambda f, i, j, name: F.when(boxed, f(at(i), at(j))).alias(name)
    return each.select(*PAGE, "line_idx", "text", x.alias("x"), y.alias("y"), h.alias("h"), "score", bound(F.least, 0, 2, "x0"), bound(F.least, 1, 3, "top"), bound(F.greatest, 0, 2, "x1"), bound(F.greatest, 1, 3, "bottom"))


def line_groups(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, groups: per page an array of groups, each an array of its lines (y, x, line_idx, text). In order of
    (y, x), a line joins the group while it is no further from the group's first line than .65 of the page's median height, at
    least 8. The fold is over one page's lines and notes where groups start."""
    line = F.struct("y", "x", "line_idx", "text")
    page = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(line)).alias("lines"), F.sort_array(F.collect_list("h")).alias("hs"))
    n = F.size("hs")
    middle = F.get("hs", F.floor((n - 1) / 2).cast("int")) * 0.5 + F.get("hs", F.floor(n / 2).cast("int")) * 0.5
    tolerance = F.greatest(F.lit(8.0), middle * 0.65)
    start = F.struct(tolerance.alias("tolerance"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, line: Column) -> Column:
        new = state["anchor"].isNull() | (F.abs(state["anchor"] - line["y"]) > state["tolerance"])
        begun = F.struct(state["tolerance"].alias("tolerance"), (state["n"] + 1).alias("n"), line["y"].alias("anchor"), F.array_append(state["starts"], state["n"]).alias("starts"))
        return F.when(new, begun).otherwise(F.struct(state["tolerance"].alias("tolerance"), (state["n"] + 1).alias("n"), state["anchor"].alias("anchor"), state["starts"].alias("starts")))

    folded = settled(page.select(*PAGE, "lines", F.aggregate("lines", start, step)["starts"].alias("starts")), "starts")
    to = lambda i: F.coalesce(F.get("starts", i + 1), F.size("lines"))
    return folded.select(*PAGE, F.transform("starts", lambda s, i: F.slice("lines", s + 1, to(i) - s)).alias("groups"))


def grouped_lines(lines: DataFrame) -> DataFrame:
    """Lines with grp, the place of their group in its page (from 0)."""
    return line_groups(lines).select(*PAGE, F.posexplode("groups").alias("grp", "g")).select(*PAGE, "grp", F.inline("g"))


def lines_to_rows(lines: DataFrame) -> DataFrame:
    """rows of grouped lines; from the first date/description/additions header of a page on, each of its texts goes to the header's nearest
    column (the leftmost of equals) and texts of one column are joined. A page is read once, in its document's partition."""
    word = lambda l: F.regexp_replace(F.lower(l["text"]), "[^a-z]", "")
    words = F.transform("groups", lambda g: F.transform(g, word))
    has = lambda g, w: F.array_contains(g, w)
    head = F.array_position(F.transform("words", lambda g: F.coalesce(has(g, "date") & has(g, "description") & (has(g, "additions") | has(g, "subtractions")), F.lit(False))), True)
    pages = settled(line_groups(lines), "groups").withColumn("words", words)
    pages = settled(pages.select(*PAGE, "groups", (F.nullif(head, F.lit(0).cast("long")).cast("int") - 1).alias("head")), "head")
    labels = F.transform(F.sort_array(F.transform(F.get("groups", F.col("head")), lambda l: F.struct(l["x"].alias("x"), l["line_idx"].alias("line_idx")))), lambda a: a["x"])
    each = pages.withColumn("anchors", labels).select(*PAGE, "head", "anchors", F.posexplode("groups").alias("grp", "g"))
    aligned = F.coalesce(F.col("grp") >= F.col("head"), F.lit(False))
    slot = lambda x: F.array_min(F.transform("anchors", lambda a, i: F.struct(F.abs(a - x).alias("off"), i.alias("i"))))["i"]
    texts = F.filter(F.transform("g", lambda l: F.struct(l["x"].alias("x"), l["line_idx"].alias("line_idx"), stripped(l["text"]).alias("text"))), lambda t: t["text"] != "")
    items = F.transform(F.sort_array(texts), lambda t: F.struct(t["text"].alias("text"), F.when(aligned, slot(t["x"])).alias("slot")))
    each = settled(each.withColumn("items", items), "items").filter(F.size("items") > 0)
    free = F.transform("items", lambda t: t["text"])
    fitted = F.transform(F.sequence(F.lit(0), F.greatest(F.size("anchors"), F.lit(1)) - 1), lambda s: F.array_join(F.transform(F.filter("items", lambda t: t["slot"] == s), lambda t: t["text"]), " "))
    cells = each.select(*PAGE, "grp", F.when(aligned, fitted).otherwise(free).alias("cells"))
    return numbered_rows(cells, "page_no", "grp")


def text_to_rows(texts: DataFrame) -> DataFrame:
    """rows of texts(doc_id, text): lines cut at two blanks or more; empty cells and lines are left out."""
    cells = F.filter(F.transform(F.split("line", r"\s{2,}"), clean_cell), lambda c: c != "")
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line_no", "line")).select("doc_id", "line_no", cells.alias("cells")).filter(F.size("cells") > 0)
    return numbered_rows(lines, "line_no")


def transaction_tables(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys of tables that look like transactions: date, detail and amount words in the first 30 rows, or three rows with
    a date and money."""
    line = F.lower(F.array_join("cells", " ", ""))
    data = line.rlike(rules.TABLE_DAY) & line.rlike(rules.TABLE_MONEY)
    each = rows.groupBy(*key).agg(*(F.bool_or((F.col("row_idx") < 30) & line.rlike(p)).alias(n) for n, p in rules.TABLE_WORDS.items()), F.count_if(data).alias("n_data"))
    return each.filter("(d AND t AND a) OR n_data >= 3").select(*key)


def document_class(pages: DataFrame, text_page: int = 120, least_pages: int = 2, least_chars: int = 700, images_per_page: float = 0.6, first: int = 8) -> DataFrame:
    """doc_id, pdf_type: digital or hybrid at the first page where enough text pages and characters have come together
    (hybrid if that page has over 3 images); else by the sums over the first pages."""
    run = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    each = pages.filter(F.col("page_no") <= first).withColumn("text_pages", F.sum((F.col("text_chars") > text_page).cast("int")).over(run)).withColumn("chars", F.sum("text_chars").over(run))
    hit = (F.col("text_pages") >= least_pages) & (F.col("chars") > least_chars)
    ends = each.groupBy("doc_id").agg(F.min_by("n_images", F.when(hit, F.col("page_no"))).alias("hit_images"), F.max(hit).alias("hit"), F.max("text_pages").alias("p"), F.sum("text_chars").alias("c"), F.sum("n_images").alias("i"), F.count("*").alias("n"))
    good, pictured = (F.col("p") >= least_pages) | (F.col("c") > least_chars), (F.col("i") > 5) | (F.col("i") / F.col("n") > images_per_page)
    early = F.when(F.col("hit"), F.when(F.col("hit_images") > 3, "hybrid").otherwise("digital"))
    late = F.when(good & pictured, "hybrid").when(good | ((F.col("c") > 400) & (F.col("i") == 0)), "digital").otherwise("scanned")
    return ends.select("doc_id", F.coalesce(early, late).alias("pdf_type"))
