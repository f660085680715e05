"""Page layout to markdown: elements of tagged pages, their order, captions, assets and rendering.

Elements are (document_id, page_number, ord, x1, y1, x2, y2, class, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ordered_join, slug, strip, word_count

#: The tags of an element: corner, content, corner, class. Fixed format of the pages.
ELEMENT = r"(?s)<x_([\d.]+)><y_([\d.]+)>(.*?)<x_([\d.]+)><y_([\d.]+)><class_([^>]+)>"
_PAGE = ("document_id", "page_number")
FIGURES = ("Picture", "Figure")
#: Pixels around a crop. Fixed values.
PADDING = {"Table": 25, "Figure": 15, "Picture": 15, "Formula": 30}


def layout_elements(pages: DataFrame) -> DataFrame:
    """One row for each element of pages (document_id, page_number, raw); text between elements is dropped."""
    # an element is matched once more, not once for each tag; of its parts only the content, put last, may hold a >
    found = F.transform(F.regexp_extract_all("raw", F.lit(ELEMENT), F.lit(0)), lambda e: F.split(F.regexp_replace(e, ELEMENT, "$1>$2>$4>$5>$6>$3"), ">", 6))
    rows = pages.select(*_PAGE, F.posexplode(found).alias("ord", "e"))
    number = lambda k: F.expr(f"try_cast(e[{k}] as double)")
    return rows.select(*_PAGE, "ord", number(0).alias("x1"), number(1).alias("y1"), number(2).alias("x2"), number(3).alias("y2"), F.col("e")[4].alias("class"), F.col("e")[5].alias("content"))


def layout_page_check(pages: DataFrame) -> DataFrame:
    """Pages with the default start tag put in, and what tells of a cut-off output."""
    starts = F.col("raw").rlike(r"^\s*<x_[\d.]+><y_[\d.]+>")
    return pages.select(*_PAGE, F.when(starts, F.col("raw")).otherwise(F.concat(F.lit("<x_0><y_0>"), "raw")).alias("fixed"), (~strip(F.col("raw")).endswith(">")).alias("truncated"), word_count(F.col("raw")).alias("n_words"), F.length("raw").alias("n_chars"))


def reading_order(elements: DataFrame) -> DataFrame:
    """Elements with `pos`, from 0, by (y1, x1) within the page, ties by their order in the text."""
    order = Window.partitionBy(*_PAGE).orderBy("y1", "x1", "ord")
    return elements.withColumn("pos", F.row_number().over(order) - 1)


def figure_names(ordered: DataFrame, doc_name: Column | None = None) -> DataFrame:
    """Figures in reading order with the file name that becomes their content."""
    k = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("pos"))
    name = F.col("document_id").cast("string") if doc_name is None else doc_name
    figures = ordered.where(F.col("class").isin(*FIGURES)).withColumn("k", k)
    return figures.select(*_PAGE, "ord", "pos", F.concat(name, F.lit("_p"), F.col("page_number"), F.lit("_fig"), F.col("k"), F.lit(".png")).alias("figure_name"))


def render(kind: Column, content: Column, style: str = "code") -> Column:
    """Markdown of an element. style="extended" is the documented variant with captions and headings of its own."""
    c = strip(content)
    out = F.when(kind.isin("List-item"), F.concat(F.lit("- "), c, F.lit("\n")))
    if style == "extended":
        out = out.when(kind == "Caption", F.concat(F.lit("**"), c, F.lit("**\n\n"))).when(kind.isin("TOC", "Bibliography"), F.concat(F.lit("## "), c, F.lit("\n\n"))).when(kind.isin("Page-header", "Page-footer"), F.concat(F.lit("_"), c, F.lit("_\n\n")))
    out = out.when(kind.isin("Title", "Section-header"), F.concat(F.lit("## "), c, F.lit("\n\n"))).when(kind == "Footnote", F.concat(F.lit("_"), c, F.lit("_\n\n"))).when(kind == "Page-footer", F.lit(""))
    return out.otherwise(F.concat(c, F.lit("\n\n")))


def render_elements(ordered: DataFrame, style: str = "code") -> DataFrame:
    """(document_id, page_number, pos, class, md) of every element that isn't a figure."""
    return ordered.where(~F.col("class").isin(*FIGURES)).select(*_PAGE, "pos", "class", render(F.col("class"), F.col("content"), style).alias("md"))


def figure_captions(ordered: DataFrame) -> DataFrame:
    """(document_id, page_number, pos, md) of figures and captions after pairing.

    A figure waits for the next caption of the page; a second figure takes its place, and one left over is rendered
    at the page's end. Among figures and captions alone, a caption is taken if a figure stands before it.
    """
    figs = figure_names(ordered).select(*_PAGE, "pos", "figure_name")
    some = ordered.where(F.col("class").isin(*FIGURES, "Caption")).join(figs, [*_PAGE, "pos"], "left")
    order = Window.partitionBy(*_PAGE).orderBy("pos")
    around = some.withColumns({"before": F.lag("figure_name").over(order), "after": F.lead("class").over(order)})
    image = lambda caption, name: F.concat(F.lit("!["), caption, F.lit("](figures/"), name, F.lit(")\n\n"))
    caption = F.when(F.col("before").isNotNull(), image(strip(F.col("content")), F.col("before"))).otherwise(F.concat(strip(F.col("content")), F.lit("\n\n")))
    left_over = F.when(F.col("after").isNull(), image(F.lit("Figura"), F.col("figure_name")))
    md = F.when(F.col("class") == "Caption", caption).otherwise(left_over)
    end = (F.col("class") != "Caption").cast("int")  # a left-over figure comes last
    return around.withColumn("md", md).where("md is not null").select(*_PAGE, end.alias("late"), "pos", "md")


def pages_to_markdown(elements: DataFrame, style: str = "code") -> DataFrame:
    """(document_id, markdown): pages by number, each page's elements in reading order."""
    ordered = reading_order(elements)
    plain = render_elements(ordered.where("class <> 'Caption'"), style).select(*_PAGE, F.lit(0).alias("late"), "pos", "md")
    parts = plain.unionByName(figure_captions(ordered))
    every = elements.select(*_PAGE).distinct().join(parts, list(_PAGE), "left")
    page = every.groupBy(*_PAGE).agg(ordered_join(F.struct("late", "pos"), F.coalesce("md", F.lit("")), "").alias("body"))
    block = F.concat(F.lit("\n\n## Página "), F.col("page_number"), F.lit("\n\n"), F.col("body"))
    docs = page.groupBy("document_id").agg(ordered_join(F.col("page_number"), block, "").alias("body"))
    return docs.select("document_id", F.concat(F.lit("# doc_"), F.col("document_id"), F.lit("\n\n"), F.col("body")).alias("markdown"))


def crop_boxes(elements: DataFrame, width: Column, height: Column) -> DataFrame:
    """Pixel boxes of assets: corners in order, padded by class, within the image."""
    pad = F.coalesce(*[F.when(F.col("class") == k, F.lit(v)) for k, v in PADDING.items()])
    x, y = lambda c: F.floor(c * width), lambda c: F.floor(c * height)
    rows = elements.where(F.col("class").isin(*PADDING)).withColumn("pad", pad)
    box = {
        "left": F.greatest(F.lit(0), x(F.least("x1", "x2")) - F.col("pad")),
        "top": F.greatest(F.lit(0), y(F.least("y1", "y2"))),
        "right": F.least(width, x(F.greatest("x1", "x2")) + F.col("pad")),
        "bottom": F.least(height, y(F.greatest("y1", "y2"))),
    }
    return rows.select(*_PAGE, "ord", "class", *[c.cast("int").alias(n) for n, c in box.items()])


def nearest_caption(elements: DataFrame) -> DataFrame:
    """(document_id, page_number, ord, class, caption) of tables and figures.

    The nearest caption at or below the element's middle, else the nearest at all, ties by text order; none: empty.
    """
    middle = F.round((F.col("y1") + F.col("y2")) / 2, 6)
    assets = elements.where(F.col("class").isin("Table", *FIGURES)).select(*_PAGE, "ord", "class", middle.alias("mid"))
    captions = elements.where("class = 'Caption'").select(*_PAGE, F.col("ord").alias("c_ord"), middle.alias("c_mid"), strip(F.col("content")).alias("c"))
    both = assets.join(captions, list(_PAGE), "left")
    rank = F.struct((F.col("c_mid") < F.col("mid")).alias("above"), F.round(F.abs(F.col("c_mid") - F.col("mid")), 6).alias("far"), "c_ord")
    return both.groupBy(*_PAGE, "ord", "class").agg(F.coalesce(F.min_by("c", F.when(F.col("c").isNotNull(), rank)), F.lit("")).alias("caption"))


def asset_names(elements: DataFrame) -> DataFrame:
    """Names of assets by page: figures numbered, tables by caption; a table's name gets its page on a clash."""
    named = nearest_caption(elements)
    table = F.col("class") == "Table"
    k = F.row_number().over(Window.partitionBy(*_PAGE, table).orderBy("ord"))
    rows = named.withColumns({"k": k, "is_table": table})
    figure = F.concat(F.col("document_id"), F.lit("_p"), F.col("page_number"), F.lit("_fig"), F.col("k"))
    rows = rows.withColumn("base", F.when(F.col("is_table"), slug(F.col("caption"), F.concat(F.lit("table_"), F.col("k")))).otherwise(figure))
    clash = F.count("*").over(Window.partitionBy("document_id", "base")) > 1
    name = F.when(F.col("is_table") & clash, F.concat("base", F.lit("_p"), F.col("page_number"), F.lit("_"), F.col("k"))).otherwise(F.col("base"))
    return rows.select(*_PAGE, "ord", "class", "k", name.alias("asset_name"))


def page_asset_counts(elements: DataFrame) -> DataFrame:
    count = lambda *kinds: F.count_if(F.col("class").isin(*kinds))
    return elements.groupBy(*_PAGE).agg(count(*FIGURES).alias("n_figures"), count("Table").alias("n_tables"), count(*PADDING).alias("n_boxes"))


#: Folders of assets by kind. Fixed values.
ASSET_FOLDERS = {"image": "extracted_images", "table": "extracted_tables", "page": "annotated_pages"}


def asset_path(kind: str, document: Column, name: Column) -> Column:
    """The path of an image, a table or an annotated page below the root of all assets."""
    return F.concat_ws("/", F.lit(ASSET_FOLDERS[kind]), document, name)


def asset_page_link(assets: DataFrame, pages: DataFrame, kind: str = "image") -> DataFrame:
    """Assets (document_id, name) with the page that their name tells, null if there is none, and their position."""
    told = F.expr("try_cast(nullif(regexp_extract(name, '_p([0-9]+)_', 1), '') as int)")
    position = F.row_number().over(Window.partitionBy("document_id").orderBy("name")) - 1
    rows = assets.withColumns({"told": told, "position": position})
    known = pages.select("document_id", F.col("page_number").alias("told"), F.col("page_number").alias("linked_page")).distinct()
    return rows.join(known, ["document_id", "told"], "left").select("document_id", "name", "position", "linked_page", asset_path(kind, F.col("document_id"), F.col("name")).alias("path"))


def latex_table_md(c: Column) -> Column:
    """A LaTeX tabular as a markdown table: multirow and multicolumn unwrapped, bold kept, rows and cells split."""
    body = F.regexp_replace(F.regexp_extract(c, r"(?s)\\begin\{tabular\}\{[^}]*\}(.*?)\\end\{tabular\}", 1), r"\\hline", "")
    body = F.regexp_replace(body, r"\\multi(?:row|column)\{[^}]*\}\{[^}]*\}\{([^}]*)\}", "$1")
    body = F.regexp_replace(body, r"\\textbf\{([^}]*)\}", "**$1**")
    rows = F.filter(F.transform(F.split(body, r"\\\\"), strip), lambda r: r != "")
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.split(r, "&"), strip), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.split(rows[0], "&"))))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")).otherwise("")
