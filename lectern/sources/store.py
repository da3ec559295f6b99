"""Files, JSON states and the stored chunk and vector indexes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import params as P
from lectern.functions import text as X
from lectern.operators import chunking
from lectern.sources.scratch import materialise


def _inside(path: Column, root: str) -> Column:
    base = "/" + root.removeprefix("file:").strip("/")
    return F.substr(path, F.lit(len(base) + 2), F.length(path))


def extension_glob(extensions: Sequence[str]) -> str:
    """A path filter for names that end so, whatever their case."""
    either = lambda c: f"[{c.lower()}{c.upper()}]" if c.isalpha() else c
    return "*{" + ",".join("".join(map(either, e)) for e in extensions) + "}"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def in_catalog(relative: Column) -> Column:
    """Files below a course folder, of a kind that can be read, without a name that begins with a dot at any level."""
    parts = F.split(relative, "/")
    return (F.size(parts) > 1) & ~F.exists(parts, lambda p: p.startswith(".")) & extension(relative).isin(*P.EXTENSIONS)


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """course_id, course, file_id, file_name, path, relative, extension, size, modified_at of all files that can be read.

    The first-level folder is the course; files directly under the root, names that begin with a dot at any level and
    other extensions are left out. Spark's own listing also leaves out names that begin with an underscore. Contents are
    not read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", extension_glob(P.EXTENSIONS))
    rows = found.load(root).drop("content")
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = rows.withColumn("path", path).withColumn("relative", _inside(F.col("path"), root))
    parts = F.split("relative", "/")
    rows = rows.withColumns({"parts": parts, "file_name": F.element_at(parts, -1)})
    rows = rows.withColumn("extension", extension(F.col("file_name"))).filter(in_catalog(F.col("relative")))
    course = F.get("parts", F.lit(0))
    folder = F.concat(F.lit("/" + root.removeprefix("file:").strip("/") + "/"), course)
    return rows.select(
        X.stable_id(folder).alias("course_id"), course.alias("course"), X.stable_id(F.col("path")).alias("file_id"), "file_name", "path", "relative", "extension",
        F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"),
    )


def courses_of(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """course, file_count; folders (course) adds those without files."""
    counts = files.groupBy("course").agg(F.count("*").alias("file_count"))
    return counts if folders is None else folders.select("course").distinct().join(counts, "course", "left").fillna(0)


def _page_columns(path: Column, relative: Column, page: Column, page_seq: Column, text: Column) -> list[Column]:
    return [
        F.substring_index(relative, "/", 1).alias("course_id"), X.stable_id(path).alias("file_id"), F.substring_index(relative, "/", -1).alias("file_name"),
        relative.alias("path"), relative.alias("file_ord"), page.cast("int").alias("page"), page_seq.cast("int").alias("page_seq"), text.alias("text"),
    ]


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file with tabs and breaks, blank ones left out."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for paragraph in root.iter(f"{ns}p"):
        marks = {f"{ns}tab": "\t", f"{ns}br": "\n", f"{ns}cr": "\n"}
        line = "".join((e.text or "") if e.tag == f"{ns}t" else marks.get(e.tag, "") for e in paragraph.iter())
        if line.strip():
            lines.append(line.strip())
    return "\n".join(lines)


#: path, page (null without numbers), text of the pages of a PDF; the library reads none itself.
PdfReader = Callable[[bytes], Sequence[tuple[int | None, str]]]


def _pages(path: str, content: bytes, pdf: PdfReader | None) -> list[tuple[int | None, str]]:
    name, kind = path.rsplit("/", 1)[-1], "." + path.lower().rsplit(".", 1)[-1]
    if kind in P.TEXT_EXTENSIONS:
        return [(None, content.decode("utf-8", "ignore"))]
    if kind in P.IMAGE_EXTENSIONS:
        return [(None, f"图片文件已保存：{name}，需要 OCR 才能检索。")]
    try:
        found = [(None, docx_text(content))] if kind == ".docx" else list(pdf(content)) if pdf else []
    except Exception:  # noqa: BLE001  a broken file is one bad page, which the quality report finds
        found = []
    found = [(page, text) for page, text in found if text]
    return found or [(None, f"{kind[1:].upper()} 解析失败：{name}。请确认文件未损坏。")]


def extract_pages(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """path, page, page_seq, text of files (path, content), by extension in any case: text files as one page, without
    bytes that are no UTF-8; DOCX by paragraphs; images a placeholder; PDF by the given reader. A file that cannot be
    read, or that has no text, gives one page with an error sentence. Files of other kinds give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows += [(path, page, seq, text) for seq, (page, text) in enumerate(_pages(path, content, pdf))]
            yield pd.DataFrame(rows, columns=["path", "page", "page_seq", "text"]).astype({"page": "Int64"})

    known = files.filter(extension(F.col("path")).isin(*P.EXTENSIONS)).select("path", "content")
    return known.mapInPandas(run, "path string, page int, page_seq int, text string")


def extract_docx_pages(files: DataFrame) -> DataFrame:
    """path, page, text of DOCX files and images (path, content)."""
    return extract_pages(files.filter(extension(F.col("path")).isin(".docx", *P.IMAGE_EXTENSIONS))).drop("page_seq")


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def pages_of_files(files: DataFrame, root: str, pdf: PdfReader | None = None) -> DataFrame:
    """Pages, as build_chunks takes them, of rows of a binaryFile source that belong to the catalog of root."""
    rows = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    rows = extract_pages(rows.filter(in_catalog(_inside(F.col("path"), root))), pdf)
    return rows.select(*_page_columns(F.col("path"), _inside(F.col("path"), root), F.col("page"), F.col("page_seq"), F.col("text")))


def read_pages(spark: SparkSession, root: str, pdf: PdfReader | None = None, kinds: Sequence[str] = P.EXTENSIONS) -> DataFrame:
    """The pages of all files of the catalog of these kinds; stream_ingest brings the same ones. Others are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", extension_glob(kinds)).load(root)
    return pages_of_files(files, root, pdf)


def read_text_pages(spark: SparkSession, root: str) -> DataFrame:
    """One page for each .md, .markdown or .txt file, in any case, of the catalog; bytes that are no UTF-8 are dropped."""
    return read_pages(spark, root, kinds=P.TEXT_EXTENSIONS)


_CASE = """array<struct<id string, course_id string, question string, expected_files string, expected_reference_files string, min_quality string,
    tags string, expected_terms string, expected_answer_terms string, forbidden_terms string, min_answer_term_rate double, max_unsupported_claims int>>"""


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON files: a list, or an object with `cases`; a single value stands for a list of one."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.cases"), _CASE), F.from_json("value", _CASE))
    rows = raw.select(F.explode(listed).alias("c")).select("c.*")

    def many(*names: str) -> Column:
        value = F.coalesce(*[F.col(n) for n in names])
        parsed = F.from_json(value, "array<string>")
        return F.when(value.isNull(), X.empty_strings()).when(value.startswith("["), parsed).otherwise(F.array(value))

    return rows.select(
        F.coalesce(F.nullif("id", F.lit("")), F.substr("question", F.lit(1), F.lit(32))).alias("case_id"), X.text_or_empty(F.col("course_id")).alias("course_id"), X.strip(F.col("question")).alias("question"),
        many("expected_files", "expected_reference_files").alias("expected_files"), X.coerce_choice(F.col("min_quality"), ("none", "partial", "sufficient"), "partial").alias("min_quality"),
        many("tags").alias("tags"), many("expected_terms", "expected_answer_terms").alias("expected_terms"), many("forbidden_terms").alias("forbidden_terms"),
        F.coalesce("min_answer_term_rate", F.lit(1.0)).alias("min_answer_term_rate"), "max_unsupported_claims",
    )


def read_state_json(spark: SparkSession, path: str, item: T.StructType, key: str = "chunks") -> DataFrame:
    """Rows of state files: a bare list, or an object that holds the list under key. A file that is missing, broken or
    of another shape gives no row."""
    kind = T.ArrayType(item)
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as error:  # noqa: BLE001  only a missing path is a default; all else is raised again
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], item)
    listed = F.coalesce(F.from_json(F.get_json_object("value", f"$.{key}"), kind), F.from_json("value", kind))
    return raw.select(F.explode(listed).alias("c")).select("c.*").filter(F.coalesce(*[F.col(f.name).isNotNull() for f in item.fields[:1]]))


# The stored chunk index. A commit writes the chunks of the courses that it touches under data/commit=<id>, then which
# commit each course is read from under courses/commit=<id>, and last, as one file that is moved into its place, the next
# version. Readers take the newest version: a job that fails before that leaves the state as it was, and what it has
# written is never read.


def hadoop_files(spark: SparkSession, path: str) -> tuple[object, Callable[[str], object]]:
    """The file system that holds path, and the constructor of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def index_version(spark: SparkSession, path: str) -> dict | None:
    """The newest version: number, commit, schema and, of each writer, the last batch; None without one."""
    fs, make = hadoop_files(spark, path)
    folder = make(f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))
    if not numbers:
        return None
    stream = fs.open(make(f"{path}/versions/{numbers[-1]:012}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: dict) -> None:
    """The step that makes a commit visible. One job at a time writes an index: a second one finds its number taken."""
    fs, make = hadoop_files(spark, path)
    place, draft = make(f"{path}/versions/{version['number']:012}.json"), make(f"{path}/versions/_{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version['number']} of {path} has been written by another job")


def _courses(spark: SparkSession, path: str, version: dict) -> DataFrame:
    return spark.read.schema("course_id string, commit string").parquet(f"{path}/courses/commit={version['commit']}")


def read_chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the newest version. Only the folders of commits that some course is read from are opened."""
    version = index_version(spark, path)
    if version is None:
        raise ValueError(f"{path} holds no chunk index")
    courses = _courses(spark, path, version)
    live = [r["commit"] for r in courses.select("commit").distinct().collect()]  # one for each commit, until vacuum
    if not live:
        return spark.createDataFrame([], T.StructType.fromJson(version["schema"]))
    schema = T.StructType.fromJson(version["schema"])
    stored = T.StructType([*(f for f in schema.fields if f.name != "course_id"), T.StructField("course_id", T.StringType()), T.StructField("commit", T.StringType())])
    rows = spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*(f"{path}/data/commit={c}" for c in live))
    here = courses.withColumnsRenamed({"course_id": "_course", "commit": "_commit"})
    same = F.col("course_id").eqNullSafe(F.col("_course")) & (F.col("commit") == F.col("_commit"))
    return rows.join(here, same, "left_semi").select(*schema.names)


def _commit(spark: SparkSession, path: str, chunks: DataFrame, touched: DataFrame, writer: str | None, batch: int | None) -> None:
    """chunks become all that the touched courses (course_id) have."""
    before = index_version(spark, path)
    commit = uuid.uuid4().hex
    chunks.write.partitionBy("course_id").parquet(f"{path}/data/commit={commit}")
    new = chunks.select(F.col("course_id").cast("string").alias("course_id"), F.lit(commit).alias("commit")).distinct()
    if before is not None:
        gone = touched.select(F.col("course_id").cast("string").alias("_course")).distinct()
        new = _courses(spark, path, before).join(gone, F.col("course_id").eqNullSafe(F.col("_course")), "left_anti").unionByName(new)
    new.write.parquet(f"{path}/courses/commit={commit}")
    batches = dict(before["batches"]) if before else {}
    if writer is not None:
        batches[writer] = batch
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in chunks.schema.fields])
    _publish(spark, path, {"number": before["number"] + 1 if before else 1, "commit": commit, "batches": batches, "schema": schema.jsonValue()})


def _stamped(chunks: DataFrame) -> DataFrame:
    out = chunks.withColumns({"schema_version": F.lit(P.SCHEMA_VERSION), "tokenizer_version": F.lit(P.TOKENIZER_VERSION)})
    return out.withColumn("course_id", F.col("course_id").cast("string"))


def write_chunk_index(chunks: DataFrame, path: str) -> None:
    """Replace the courses that chunks has, and no others."""
    rows = materialise(_stamped(chunks))
    _commit(chunks.sparkSession, path, rows, rows.select("course_id"), None, None)


def vacuum_chunk_index(spark: SparkSession, path: str) -> int:
    """Delete what the newest version does not read: replaced commits, those of failed jobs, older versions. Not to be
    run beside a writer, or while an older version is being read. Returns the number of folders deleted."""
    version = index_version(spark, path)
    if version is None:
        return 0
    fs, make = hadoop_files(spark, path)
    live = {r["commit"] for r in _courses(spark, path, version).select("commit").distinct().collect()}
    keep = {f"data/commit={c}" for c in live} | {f"courses/commit={version['commit']}", f"versions/{version['number']:012}.json"}
    found = [f"{kind}/{s.getPath().getName()}" for kind in ("data", "courses", "versions") for s in fs.listStatus(make(f"{path}/{kind}"))]
    gone = [name for name in found if name not in keep and not name.rsplit("/", 1)[-1].startswith(".")]
    for name in gone:
        fs.delete(make(f"{path}/{name}"), True)
    return len(gone)


def merge_chunks(index: DataFrame, pages: DataFrame) -> DataFrame:
    """The index with the chunks of the pages in place of those of the same file and page (null equals null). New chunks
    are numbered behind the highest number of their course, so no id is given twice."""
    new = chunking.build_chunks(pages)
    old, fresh = index.alias("o"), pages.select("course_id", "file_id", "page").distinct().alias("n")
    same = (F.col("o.course_id") == F.col("n.course_id")) & (F.col("o.file_id") == F.col("n.file_id")) & F.col("o.page").eqNullSafe(F.col("n.page"))
    kept = old.join(fresh, same, "left_anti")
    top = index.groupBy("course_id").agg(F.max("chunk_index").alias("top"))
    page = F.when(F.coalesce("page", F.lit(0)) == 0, F.lit("text")).otherwise(F.col("page").cast("string"))
    new = new.join(top, "course_id", "left").withColumn("chunk_index", F.col("chunk_index") + F.coalesce("top", F.lit(0))).drop("top")
    new = new.withColumn("id", F.concat_ws("-", "file_id", page, F.col("chunk_index").cast("string")))
    columns = [c for c in new.columns if c in index.columns]
    return kept.select(*columns).unionByName(new.select(*columns))


def upsert_chunks(spark: SparkSession, path: str, pages: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
    """Bring pages into a stored index; only the courses of the pages are written again, and a course that is left
    without chunks is no longer read. With the writer's name and a rising number of the batch, a batch that has been
    brought in before changes nothing: false is returned then."""
    version = index_version(spark, path)
    if writer is not None and version is not None and version["batches"].get(writer, -1) >= batch:
        return False
    pages = materialise(pages)
    touched = pages.select("course_id").distinct()
    if version is None:
        merged = chunking.build_chunks(pages)
    else:
        index = read_chunk_index(spark, path).drop("schema_version", "tokenizer_version")
        merged = merge_chunks(index.join(touched, "course_id", "left_semi"), pages)
    _commit(spark, path, materialise(_stamped(merged)), touched, writer, batch)
    return True


def fingerprint(provider: Column, base_url: Column, model: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat_ws("\n", provider, base_url, model), 256), 1, 16))


def write_vector_index(vectors: DataFrame, path: str, model_type: str, dimensions: int, print_: str) -> None:
    header = {"model_type": F.lit(model_type), "dimensions": F.lit(dimensions), "fingerprint": F.lit(print_), "schema_version": F.lit(P.VECTOR_VERSION)}
    vectors.withColumns(header).write.mode("overwrite").parquet(path)


def read_vector_index(spark: SparkSession, path: str, model_type: str, dimensions: int, print_: str, chunks: int | None = None) -> DataFrame:
    """The vectors, if header and rows fit the model; else an error. With chunks, also if there are as many rows."""
    rows = spark.read.parquet(path)
    size = F.size("vector")
    found = rows.agg(
        F.min(size), F.max(size), F.collect_set("model_type"), F.collect_set("dimensions"), F.collect_set("fingerprint"), F.count("*")
    ).first()
    if list(found[:2]) != [dimensions] * 2 or [list(x) for x in found[2:5]] != [[model_type], [dimensions], [print_]]:
        raise ValueError("the vector index belongs to another model")
    if chunks is not None and found[5] != chunks:
        raise ValueError("the vector index is stale")
    return rows


def safe_path(path: Column) -> Column:
    """Relative, without backslash, dots or empty parts."""
    return ~(path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.{1,2}(/|$)") | path.contains("//") | (path == ""))


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, size, sha256, kind, index_version of what a backup holds: course_memory, indexes and the example config.
    Nothing else under the root is listed or opened; a root without any of them gives no row."""
    fs, make = hadoop_files(spark, root)
    held = [f"{root}/{name}" for name in ("course_memory", "indexes", "config.example.json") if fs.exists(make(f"{root}/{name}"))]
    if not held:
        return spark.createDataFrame([], "path string, size long, sha256 string, kind string, index_version int")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(held)
    rows = rows.withColumn("path", _inside(F.regexp_replace("path", "^file:/+", "/"), root))
    kind = F.when(F.col("path").startswith("course_memory/"), "memory").when(F.col("path").startswith("indexes/"), "index").when(F.col("path") == "config.example.json", "config")
    version = F.when(F.col("path").endswith(".json"), F.get_json_object(F.col("content").cast("string"), "$.schema_version").try_cast("int"))
    rows = rows.filter(safe_path(F.col("path")))
    return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"), version.alias("index_version"))
