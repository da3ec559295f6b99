"""Pages to chunks: sections under their headings, overlapping windows, numbers across a course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import params as P
from lectern.functions import text as X
from lectern.sources.scratch import materialise

_HEADING = r"(?U)^\s{0,3}#{1,6}\s+(.+?)\s*$"
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_RARE_BREAKS = r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def _lines(text: Column) -> Column:
    """Most texts have line feeds only, at which a text is cut without a search."""
    return F.when(text.rlike(_RARE_BREAKS), F.split(text, _BREAKS)).otherwise(F.split(text, "\n"))


def _is_heading(line: Column) -> Column:
    return line.contains("#") & line.rlike(_HEADING)


def split_sections(text: Column) -> Column:
    """array<struct<title, text>>: the lines under each heading, the heading's text being their first line. Lines
    before the first heading have the title ''. Blank sections go; an empty page is one section."""
    text = X.text_or_empty(text)

    def cut(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: _is_heading(F.element_at(lines, i)))
        return X.let(heads, lambda hs: sections(lines, F.when(F.get(hs, F.lit(0)) == 1, hs).otherwise(F.concat(F.array(F.lit(1)), hs))))

    def sections(lines: Column, starts: Column) -> Column:
        return X.let(starts, lambda ss: F.transform(ss, lambda start, k: section(lines, ss, start, k)))

    def section(lines: Column, starts: Column, start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(lines) + 1)
        first = F.element_at(lines, start)
        is_head = _is_heading(first)
        title = F.when(is_head, X.strip(F.regexp_extract(first, _HEADING, 1))).otherwise("")
        body = F.slice(lines, start, end - start)
        body = F.when(is_head, F.concat(F.array(title), F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))))).otherwise(body)
        return F.struct(title.alias("title"), X.strip(F.array_join(body, "\n")).alias("text"))

    found = F.filter(X.let(_lines(text), cut), lambda s: s.text != "")
    whole = F.array(F.struct(F.lit("").alias("title"), text.alias("text")))
    return F.when(text == "", whole).otherwise(found)


def window_text(text: Column, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> Column:
    """Windows of `size` characters of the collapsed text, each starting size - overlap behind the last."""
    step = max(size - overlap, 1)

    def cut(clean: Column) -> Column:
        last = F.ceil(F.greatest(F.length(clean) - size, F.lit(0)) / step).cast("int")
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(clean, i * step + 1, F.lit(size)))
        return F.when(clean == "", X.empty_strings()).otherwise(windows)

    return X.let(X.collapse(text), cut)


def material_type(file_name: Column, path: Column) -> Column:
    text = F.lower(F.concat_ws("/", X.text_or_empty(path), X.text_or_empty(file_name)))
    out = F.lit("material")
    for kind, words in reversed(P.MATERIAL_TYPES):
        out = F.when(X.contains_any(text, words), kind).otherwise(out)
    return out


def is_generated() -> Column:
    """Of rows (file_name, path): a file under the generated folder, or a generated summary or exercise by its name."""
    name = F.col("file_name").rlike(r"^课程摘要-") | F.col("file_name").rlike(r"^练习题-\d{8}-\d{6}\.md$")
    inside = F.array_contains(F.split(F.coalesce("path", F.lit("")), "/"), P.GENERATED_FOLDER)
    return inside | F.coalesce(name, F.lit(False))


def exclude_generated(rows: DataFrame) -> DataFrame:
    """Rows (file_name, path) without generated files: those under the generated folder and generated summaries and
    exercises by their names."""
    return rows.filter(~is_generated())


def build_chunks(pages: DataFrame) -> DataFrame:
    """course_id, file_id, file_name, path, page, section_title, material_type, chunk_index, id, text, tokens.

    pages: course_id, file_id, file_name, path, file_ord, page, page_seq, text; (course_id, file_ord, page_seq) names
    a page. Chunks are numbered from 1 across a course. Each page counts its own chunks; a running sum over the pages'
    counts gives its first number, so the texts are never sorted and a giant course is no single task's work. Null or
    blank texts make no chunk.
    """
    parts = F.flatten(
        F.transform(
            split_sections(F.col("text")),
            lambda s: F.transform(window_text(s.text), lambda w: F.struct(s.title.alias("section_title"), w.alias("text"))),
        )
    )
    key = ["course_id", "file_ord", "page_seq"]
    cut = materialise(pages.withColumn("parts", parts).drop("text"))  # read twice: for the counts and for the texts
    counts = cut.select(*key, F.size("parts").alias("n"))
    before = F.sum("n").over(Window.partitionBy("course_id").orderBy("file_ord", "page_seq").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(*key, F.coalesce(before, F.lit(0)).alias("first"))
    rows = cut.join(firsts, key).select("*", F.posexplode("parts").alias("at", "part")).select(
        "course_id", "file_id", "file_name", "path", "page",
        F.col("part.section_title").alias("section_title"),
        material_type(F.col("file_name"), F.col("path")).alias("material_type"),
        (F.col("first") + F.col("at") + 1).alias("chunk_index"),
        F.col("part.text").alias("text"),
    )
    page = F.when(F.coalesce("page", F.lit(0)) == 0, F.lit("text")).otherwise(F.col("page").cast("string"))
    return rows.withColumns(
        {
            "id": F.concat_ws("-", "file_id", page, F.col("chunk_index").cast("string")),
            "tokens": X.tokenize_lexical(F.concat_ws("\n", "section_title", "text")),
        }
    )


def neighbor_context(chunks: DataFrame) -> DataFrame:
    """chunks with context_text: the chunk before, the chunk, the chunk after, of the same file and page only. The chunks
    of a page follow each other, so a window holds one page, not a course."""
    w = Window.partitionBy("course_id", "file_id", "page").orderBy("chunk_index")
    return chunks.withColumn("context_text", F.concat_ws("\n", F.lag("text").over(w), F.col("text"), F.lead("text").over(w)))
