"""The stored chunk index under failures and repeats, and files of all kinds by batch and by stream."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import quality
from lectern.sources import store
from lectern.streaming import jobs

PAGE = "course_id string, file_id string, file_name string, path string, file_ord string, page int, page_seq int, text string"


def page(course, name, text, number=None):
    return (course, name, f"{name}.md", f"{course}/{name}.md", name, number, 0, text)


def texts(spark, path):
    return {(r.course_id, r.text) for r in store.read_chunk_index(spark, path).collect()}


def test_a_job_that_fails_between_its_steps_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    frame = lambda *rows: spark.createDataFrame(list(rows), PAGE)
    store.write_chunk_index(store.chunking.build_chunks(frame(page("a", "f", "old words"), page("b", "g", "other"), page("x y/ü", "h", "odd name"))), path)
    before = texts(spark, path)
    assert before == {("a", "old words"), ("b", "other"), ("x y/ü", "odd name")}

    def broken(*_):
        raise OSError("lost")

    for step in ("_publish", "_courses"):
        with monkeypatch.context() as m:
            m.setattr(store, step, broken)
            with pytest.raises(OSError):
                store.upsert_chunks(spark, path, frame(page("a", "f", "new words"), page("b", "g", " ")))
        assert texts(spark, path) == before
    assert store.upsert_chunks(spark, path, frame(page("a", "f", "new words"), page("b", "g", " ")))
    after = {("a", "new words"), ("x y/ü", "odd name")}
    assert texts(spark, path) == after and store.index_version(spark, path)["number"] == 2
    assert store.vacuum_chunk_index(spark, path) >= 3 and texts(spark, path) == after
    assert store.vacuum_chunk_index(spark, path) == 0


def test_two_writers_do_not_take_the_same_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rows = store.chunking.build_chunks(spark.createDataFrame([page("a", "f", "one")], PAGE))
    store.write_chunk_index(rows, path)
    stale = store.index_version(spark, path)
    store.write_chunk_index(rows, path)
    with monkeypatch.context() as m:
        m.setattr(store, "index_version", lambda *_: stale)
        with pytest.raises(RuntimeError):
            store.write_chunk_index(rows, path)
    assert store.index_version(spark, path)["number"] == 2


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    one, two = (spark.createDataFrame([page("a", "f", t)], PAGE) for t in ("first", "second"))
    assert store.upsert_chunks(spark, path, one, "w", 0) and store.upsert_chunks(spark, path, two, "w", 1)
    version = store.index_version(spark, path)
    assert not store.upsert_chunks(spark, path, one, "w", 0) and not store.upsert_chunks(spark, path, one, "w", 1)
    assert store.index_version(spark, path) == version and texts(spark, path) == {("a", "second")}
    assert store.upsert_chunks(spark, path, one, "other", 0) and store.index_version(spark, path)["batches"] == {"w": 1, "other": 0}
    with pytest.raises(ValueError):
        store.read_chunk_index(spark, str(tmp_path / "nothing"))


def docx(*lines):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


TREE = {
    "Course 1/week 1/a.md": b"# Title\nhello stack", "Course 1/b.Md": b"heap \xff words", "Course 1/c+d.TXT": b"plus name", "c2/e.Markdown": b"marked down",
    "c2/f.DOCX": docx("one", "", "two"), "c2/empty.docx": docx(""), "c2/broken.docx": b"no zip", "c2/pic.BMP": b"x", "c2/p.pdf": b"%PDF",
    "c2/g.bin": b"binary", "c2/h.pptx": b"slides", "c2/i.mp4": b"film", "c2/.hidden/x.md": b"hidden", "c2/.y.md": b"hidden", "top.md": b"top",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("courses")
    for name, content in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_files_of_all_kinds(spark, tree):
    found = {r.relative for r in store.scan_catalog(spark, tree).collect()}
    kept = {n for n in TREE if n.count("/") and "/." not in n and n.rsplit(".", 1)[1].lower() not in ("bin", "pptx", "mp4")}
    assert found == kept
    got = {r.path: (r.page, r.text) for r in store.read_pages(spark, tree).collect()}
    assert set(got) == kept and got["c2/f.DOCX"] == (None, "one\ntwo") and got["Course 1/b.Md"][1] == "heap  words"
    assert all("解析失败" in got[f"c2/{n}"][1] for n in ("empty.docx", "broken.docx", "p.pdf")) and "图片文件已保存" in got["c2/pic.BMP"][1]
    plain = {r.path: r.text for r in store.read_text_pages(spark, tree).collect()}
    assert plain == {n: got[n][1] for n in kept if n.rsplit(".", 1)[1].lower() in ("md", "txt", "markdown")}
    two = store.read_pages(spark, tree, pdf=lambda content: [(1, "first"), (2, "second")]).filter("file_name = 'p.pdf'")
    assert sorted((r.page, r.page_seq, r.text) for r in two.collect()) == [(1, 0, "first"), (2, 1, "second")]


def test_the_stream_brings_what_the_batch_does(spark, tree, tmp_path):
    index, report = str(tmp_path / "index"), str(tmp_path / "report")
    for _ in range(2):  # the second run finds nothing new
        query = jobs.stream_ingest(spark, tree, index, str(tmp_path / "ck"), max_files=4, report_path=report)
        query.awaitTermination(180)
        assert query.exception() is None
    pages = store.read_pages(spark, tree)
    batch = store.chunking.build_chunks(pages)
    key = ["course_id", "file_id", "path", "page", "section_title", "text"]
    rows = lambda df: sorted(map(str, df.select(*key).collect()))
    assert rows(store.read_chunk_index(spark, index)) == rows(batch)
    judged = {(r.file_id, r.status) for r in spark.read.parquet(report).collect()}
    assert judged == {(r.file_id, r.status) for r in quality.parser_quality(pages).collect()}
    assert len([d for d in os.listdir(report) if d.startswith("batch=")]) >= 3


def test_the_manifest_opens_three_places_only(spark, tmp_path):
    for name in ("indexes/c.json", "course_memory/c/n.json", "config.example.json", "big/videos.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"schema_version": 3}')
    out = store.file_manifest(spark, str(tmp_path))
    assert {r.path for r in out.collect()} == {"indexes/c.json", "course_memory/c/n.json", "config.example.json"}
    assert not any("videos" in f for f in out.select(F.input_file_name().alias("f")).toPandas()["f"])
    assert store.file_manifest(spark, str(tmp_path / "big")).count() == 0
