"""Column functions over text; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results must carry.
#: Section headers that say nothing.
SKIPPED_HEADERS = ("Internal Use Only", "Open Access", "RESEARCH ARTICLE", "Competing interests", "Acknowledgements", "Author details", "References", "Root")
#: Footer of confidential documents.
FOOTER = r"(?s)사원번호\s*:\s*\d+.*?이 문서는 SK케미칼 보안문서로서 외부반출을 금지합니다\.?"
APPENDIX_KINDS = ("별지", "별표", "장부")
SOURCE_MARK, OMITTED_MARK, SUMMARY_MARK = "출처", "(생략)", "문서 요약"
TRILLION, HUNDRED_MILLION = "조", "억"
#: Entity names in a prompt: after a field name, and in quotes.
NAMED_ENTITY = r'(?i)entity[_\s]*name["\s:]*([^"\n,]+)'
QUOTED_ENTITY = r'"([A-Z][A-Za-z0-9\s\-]{2,30})"'
#: An appendix's kind and number.
APPENDIX = r"(별지|별표|장부)(?:제)?([^<>()\[\]]+?)(?=(?:호|서식)|[<>)\]]|$)"
#: Spellings of a reference: between kind and number, and after the number.
APPENDIX_SPELLINGS = ((" ", ""), (" 제", "호"), ("", ""), ("제", "호"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down; null counts nothing."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def word_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(words(text) * F.lit(1.3)).cast("long")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """Lines as an editor counts them: a last line break opens no line."""
    breaks = F.regexp_count(text, F.lit("\n"))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def windows(items: Column, size: int, overlap: int) -> Column:
    """Slices of ``size`` that start every ``size - overlap`` items, the last ones shorter."""
    step = max(1, size - overlap)
    n = F.size(items)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: F.slice(items, i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def char_windows(text: Column, size: int, overlap: int) -> Column:
    """Character windows of four characters a token."""
    step, wide = max(1, 4 * (size - overlap)), 4 * size
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(wide)))).otherwise(F.array().cast("array<string>"))


def markdown_sections(text: Column, least: int = 80) -> Column:
    """Sections that start at level-2 headers: structs of header and content, short ones left out."""
    parts = F.transform(F.split(text, r"\n(?=## )"), lambda p: F.trim(p, F.lit(" \t\r\n")))
    full = F.filter(parts, lambda p: F.length(p) >= least)
    return F.transform(full, lambda p: F.struct(F.trim(F.regexp_replace(F.substring_index(p, "\n", 1), r"^#+", "")).alias("header"), p.alias("content")))


def without_footer(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, FOOTER, ""))


def skipped_section(header: Column, content: Column, level: Column) -> Column:
    """Sections that carry no content of their own."""
    header, content = F.coalesce(header, F.lit("")), F.coalesce(content, F.lit(""))
    return header.isin(*SKIPPED_HEADERS) | ((header == "") & (content == "")) | ((level <= 1) & (content == ""))


def date_key(text: Column) -> Column:
    """YYYYMMDD of Y-M-D, Y-M or Y; 0 for anything else and for dates that do not exist."""
    given = F.trim(text)
    full = F.when(given.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), given).when(given.rlike(r"^\d{4}-\d{1,2}$"), F.concat(given, F.lit("-1"))).when(given.rlike(r"^\d{4}$"), F.concat(given, F.lit("-1-1")))
    return F.coalesce(F.date_format(F.try_to_date(full, "y-M-d"), "yyyyMMdd").cast("int"), F.lit(0))


def glyph_noise(text: Column) -> Column:
    """Undecoded glyph names in a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"GLYPH\w*")), F.lit(0)).cast("long")


def preview(text: Column, n: int, breaks: str = " | ") -> Column:
    """The first characters on one line, with dots if there are more."""
    flat = F.replace(text, F.lit("\n"), F.lit(breaks))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("..."))).otherwise(flat)


def score_bar(score: Column, most: float, width: int = 12) -> Column:
    """A bar as long as the score's share, rounded half to even."""
    return F.repeat(F.lit("#"), F.bround(score / most * width, 0).cast("int"))


def short_id(text: Column, n: int = 12) -> Column:
    return F.left(F.md5(text), F.lit(n))


def node_text(name: Column, description: Column) -> Column:
    """What is embedded of a graph node."""
    joined = F.trim(F.concat(F.coalesce(name, F.lit("")), F.lit(": "), F.coalesce(description, F.lit(""))), F.lit(": "))
    return F.when(joined == "", "unknown").otherwise(joined)


def capped(text: Column, most: int = 50_000) -> Column:
    """A document as a prompt takes it."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..." + OMITTED_MARK))).otherwise(text)


def with_summary(summary: Column, text: Column) -> Column:
    return F.when(summary.isNotNull(), F.concat(F.lit(f"[{SUMMARY_MARK}: "), summary, F.lit("]\n\n"), text)).otherwise(text)


def with_headers(headers: Column, text: Column) -> Column:
    """Text after the headings above it."""
    return F.when(F.size(headers) > 0, F.concat(F.lit("HEADER: "), F.array_join(headers, ", "), F.lit("\n"), text)).otherwise(text)


def context_path(hierarchy: Column, between: str = " > ") -> Column:
    return F.array_join(hierarchy, between)


def without_fence(raw: Column) -> Column:
    """A model's answer without its code fence."""
    return F.regexp_replace(F.regexp_replace(F.trim(raw, F.lit(" \t\r\n")), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def json_array(raw: Column, schema: str) -> Column:
    """An array out of a model's answer: as it stands, else from the first [ to the last ]; else empty.

    Valid JSON that is no array gives an empty array.
    """
    plain = without_fence(raw)
    cut = F.regexp_extract(plain, r"(?s)\[.*\]", 0)
    whole = F.try_parse_json(plain)
    text = F.when(whole.isNotNull(), F.when(plain.startswith("["), plain)).when(cut != "", cut)
    return F.coalesce(F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), schema), F.from_json(F.lit("[]"), schema))


def fenced(raw: Column) -> Column:
    """What stands between the first two fences, or all of it."""
    return F.when(raw.contains("```"), F.trim(F.regexp_replace(F.split(raw, "```")[1], r"^json", ""), F.lit(" \t\r\n"))).otherwise(F.trim(raw, F.lit(" \t\r\n")))


def source_names(prompt: Column, most: int = 15) -> Column:
    """Entity names in a prompt, in order of first sight."""
    named = F.regexp_extract_all(prompt, F.lit(NAMED_ENTITY), F.lit(1))
    quoted = F.regexp_extract_all(prompt, F.lit(QUOTED_ENTITY), F.lit(1))
    every = F.transform(F.concat(named, quoted), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(every, lambda x: F.length(x) > 1)), 1, most)


def appendix_patterns(content: Column) -> Column:
    """Spellings under which a text may refer to its appendices."""
    flat, kinds = F.regexp_replace(content, r"\s+", ""), "|".join(APPENDIX_KINDS)
    kind, number = (F.regexp_extract_all(flat, F.lit(APPENDIX), F.lit(g)) for g in (1, 2))
    pairs = F.arrays_zip(kind.alias("kind"), number.alias("number"))
    spelled = F.flatten(F.transform(pairs, lambda p: F.array(*[F.concat(p["kind"], F.lit(a), p["number"], F.lit(b)) for a, b in APPENDIX_SPELLINGS])))
    alone = F.regexp_extract_all(flat, F.lit(rf"[(\[]+({kinds})[)\]]+"), F.lit(1))
    return F.transform(F.concat(spelled, alone), lambda p: F.lower(F.trim(p)))


def matched_appendices(content: Column, appendices: Column) -> Column:
    """The listed appendices that a text refers to, joined by a comma."""
    patterns = appendix_patterns(content)
    hit = F.filter(appendices, lambda a: (a != "") & F.exists(patterns, lambda p: F.contains(F.trim(F.lower(F.replace(a, F.lit(".pdf"), F.lit("")))), p)))
    return F.coalesce(F.array_join(hit, ", "), F.lit(""))


def file_name(name: Column, most: int = 60) -> Column:
    """A name that any file system takes."""
    return F.left(F.trim(F.regexp_replace(name, r'[\\/:*?"<>|]', "_")), F.lit(most))


def title_of(path: Column) -> Column:
    """A title from a path's file name."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.initcap(F.replace(stem, F.lit("_"), F.lit(" ")))


def large_number(n: Column) -> Column:
    """Amounts in trillions and hundred millions, rounded by their binary value (format_number does, format_string not)."""
    def units(size: float, name: str) -> Column:
        return F.concat(F.replace(F.format_number(n / size, 2), F.lit(","), F.lit("")), F.lit(name))

    return F.when(n.isNull(), "N/A").when(n >= 1e12, units(1e12, TRILLION)).when(n >= 1e8, units(1e8, HUNDRED_MILLION)).otherwise(F.format_number(n, 0))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} replaced by columns."""
    return reduce(lambda text, item: F.replace(text, F.lit(f"{{{item[0]}}}"), F.coalesce(item[1], F.lit(""))), values.items(), F.lit(template))


def sections_input(values: dict[str, Column]) -> Column:
    """Headed sections of those values that are there."""
    return F.concat_ws("\n\n", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"[{k}]\n"), v)) for k, v in values.items()])


def wiki_links(text: Column) -> Column:
    """Targets of [[links]], in order of first sight."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)"), F.lit(1)), lambda x: F.trim(x)))


def normalised_bbox(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of its page."""
    return F.struct(*[(box[k] / (width if k in ("l", "r") else height)).alias(k) for k in ("l", "t", "r", "b")])


def packed_lines(text: Column, most: int = 300) -> Column:
    """Lines joined into pieces of up to ``most`` characters; a longer line is a piece of its own."""
    def add(held: Column, line: Column) -> Column:
        last = F.get(held, F.size(held) - 1)
        fits = (F.size(held) > 0) & (F.length(last) + F.length(line) + 1 <= most)
        return F.when(fits, F.concat(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), line)))).otherwise(F.concat(held, F.array(line)))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), F.array().cast("array<string>"), add)


def piecewise_tokens(text: Column, most: int = 300, count=None) -> Column:
    """Tokens of a text counted piece by piece (see packed_lines); ``count`` is a tokenizer's, by default the estimate by words."""
    return F.aggregate(packed_lines(text, most), F.lit(0).cast("long"), lambda n, piece: n + (count or word_estimate)(piece))


def table_text(markup: Column) -> Column:
    """Cells of an HTML or Markdown table, row by row, one space between."""
    html_cells = F.transform(F.regexp_extract_all(markup, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " ")))
    rows = F.filter(F.split(markup, "\n"), lambda r: r.contains("|") & ~r.rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.flatten(F.transform(rows, lambda r: F.split(r, r"\|"))), lambda c: F.trim(c))
    return F.array_join(F.filter(F.when(markup.rlike(r"(?i)<t[dh]\b"), html_cells).otherwise(cells), lambda c: c != ""), " ")


def split_pieces(text: Column, most: int) -> Column:
    """A text of more than ``most`` words as pieces: sentences and lines, as many as fit, in order; a longer one by its words."""
    def size(x: Column) -> Column:
        return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))

    parts = F.filter(F.split(F.trim(text), r"(?<=[.!?。])\s+|\n+"), lambda x: F.trim(x) != "")
    small = F.flatten(F.transform(parts, lambda x: F.when(size(x) <= most, F.array(F.trim(x))).otherwise(F.transform(windows(F.filter(F.split(x, r"\s+"), lambda w: w != ""), most, 0), lambda ws: F.array_join(ws, " ")))))

    # each piece with its words, so that none is counted twice
    sized = F.transform(small, lambda x: F.struct(size(x).alias("n"), x.alias("x")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last"), F.lit(0).alias("n"))

    def add(held: Column, p: Column) -> Column:
        fits = (held["n"] > 0) & (held["n"] + p["n"] <= most)
        done = F.when(fits | (held["n"] == 0), held["done"]).otherwise(F.concat(held["done"], F.array(held["last"])))
        last = F.when(fits, F.concat(held["last"], F.lit(" "), p["x"])).otherwise(p["x"])
        return F.struct(done.alias("done"), last.alias("last"), F.when(fits, held["n"] + p["n"]).otherwise(p["n"]).alias("n"))

    return F.aggregate(sized, start, add, lambda held: F.when(held["n"] > 0, F.concat(held["done"], F.array(held["last"]))).otherwise(held["done"]))


def media_list(pictures: Column) -> Column:
    """JSON of the pictures (ref, image) that have an image: reference and the last part of its path."""
    kept = F.filter(pictures, lambda p: F.coalesce(p["image"], F.lit("")) != "")
    return F.to_json(F.transform(kept, lambda p: F.struct(p["ref"].alias("ref"), F.substring_index(p["image"], "/", -1).alias("name"))))


def bbox_json(boxes: Column, width: Column, height: Column) -> Column:
    """JSON of boxes (label, ref, l, t, r, b) in shares of their page."""
    def share(x: Column, by: Column) -> Column:
        return F.round(x / by, 6)

    return F.to_json(F.transform(boxes, lambda x: F.struct(x["label"].alias("label"), x["ref"].alias("ref"), *[share(x[k], width if k in ("l", "r") else height).alias(k) for k in ("l", "t", "r", "b")])))


def rounded(n: Column, places: int = 2) -> Column:
    """A number as text; N/A if there is none."""
    n = n.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), "N/A").otherwise(F.format_string(f"%.{places}f", n))


def percent(share: Column, places: int = 2) -> Column:
    """A share as percent; a dash if there is none."""
    return F.when(F.coalesce(share, F.lit(0.0)) == 0, "-").otherwise(F.concat(F.format_string(f"%.{places}f", share * 100), F.lit("%")))
